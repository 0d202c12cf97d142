"""Exact identity normalisation (Unicode compatibility form, spacing, case folding) and alias mapping."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.functions.columns import col

# The functions that run in Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The exact spellings accepted for each canonical antimicrobial name.
ANTIMICROBIAL_ALIASES = {
    "oxacillin": ("oxacillin", "苯唑西林"),
    "levofloxacin": ("levofloxacin", "左氧氟沙星"),
    "gentamicin": ("gentamicin", "庆大霉素"),
    "cefepime": ("cefepime", "头孢吡肟", "头孢吡肟(马斯平)"),
    "ceftriaxone": ("ceftriaxone", "头孢曲松"),
    "ceftazidime": ("ceftazidime", "头孢他啶"),
    "ciprofloxacin": ("ciprofloxacin", "环丙沙星"),
}

_ASCII_ONLY = r"^[\x00-\x7F]*$"
# The ASCII characters that count as white space, as an explicit class.
_ASCII_SPACE_RUN = r"[\t-\r\x1c-\x20]+"


def ascii_identity(value: str | Column) -> Column:
    """Normal form of ASCII text with built-in functions only."""
    collapsed = F.regexp_replace(F.coalesce(col(value).cast("string"), F.lit("")), _ASCII_SPACE_RUN, " ")
    return F.lower(F.trim(collapsed))


def _fold(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@F.pandas_udf(T.StringType())
def _unicode_identity(values: pd.Series) -> pd.Series:
    """Normal form of any text; each distinct spelling in an Arrow batch is folded once."""
    folded = {text: _fold(text) for text in values.dropna().unique()}
    return values.map(folded) if folded else values


# Marked so that the optimizer does not copy the Python call into every filter on its result.
unicode_identity = _unicode_identity.asNondeterministic()


def normalize_identity(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add normalised copies of text columns; ``columns`` maps source to output names.

    ASCII text is normalised in generated code. Only other text is handed to the Arrow function;
    ASCII rows pass it as NULL, so they carry no text to Python and the input is read once.
    """
    added = []
    for source, out in columns.items():
        text = F.col(source).cast("string")
        beyond_ascii = F.when(~text.rlike(_ASCII_ONLY), text)
        added.append(F.coalesce(unicode_identity(beyond_ascii), ascii_identity(source)).alias(out))
    return df.select("*", *added)


def map_alias(normalised: str | Column, aliases: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Canonical name for exactly listed spellings, blank otherwise; never a substring match."""
    table = ANTIMICROBIAL_ALIASES if aliases is None else aliases
    pairs = [F.lit(x) for name, spellings in table.items() for s in spellings for x in (s, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(normalised)), F.lit(""))
