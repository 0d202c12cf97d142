"""Personal data: fixed patterns, and terms that reveal a protected entity, measured on the whole corpus.

All steps are DataFrame expressions. Base spans come from four patterns. Their values are the protected entities.
A term t (a word) reveals an entity e by pointwise mutual information relative to the information content of e:

    disclosure(t, e) = log2(p(e|t) / p(e)) / -log2 p(e) = 1 - log2(1 / p(e|t)) / -log2 p(e)

with p(e|t) = occurrences of t in paragraphs that hold e / all occurrences of t, and p(e) the share of all words that
stand in such paragraphs, whole words outside base spans throughout. Terms at or above ``THRESHOLD`` seen in at least
``CONTEXTS`` different contexts become spans in every document, also in those without the entity. The context of a term
on the entity's line is the ``WINDOW`` words around the entity, that of a term on another line is a min-hash of the
document, so copies of one line or document count once, near copies mostly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 8
THRESHOLD = 0.9
CONTEXTS = 3
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# The four patterns. A match that would begin inside a run of its first class can only begin at the
# run's start or right after the last match, and possessive repeats need no stack; both leave the matches as they are.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_PUNCTUATION = ".,;:!?()[]{}\"<>*#$%&|=/\\\t\n\x0b\x0c\r"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, x: total + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<start:int,kind_order:int,end:int,kind:string,value:string>>"
_BLOCK = 256


def _located(text: Column, pattern: Column, kind: str, order: int) -> Column:
    """array<struct<start, kind_order, end, kind, value>> of all matches, in code points, end exclusive.

    The text is cut once into gaps and matches. Spans gather in blocks of ``_BLOCK``, as each addition to an array copies it.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("block"), F.expr(f"cast(array() as array<{_SPANS}>)").alias("full")
    )

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        span = F.array(F.struct(
            begin.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("value")
        ))
        whole = F.size(state["block"]) >= _BLOCK
        return F.struct(
            end.alias("at"), F.when(whole, span).otherwise(F.concat(state["block"], span)).alias("block"),
            F.when(whole, F.concat(state["full"], F.array(state["block"]))).otherwise(state["full"]).alias("full"),
        )

    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    matched = F.filter(pairs, lambda p: p["match"].isNotNull())  # a gap more than matches
    return F.aggregate(matched, start, step, lambda state: F.flatten(F.concat(state["full"], F.array(state["block"]))))


def _kept(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _of_kind(kind: str, spans: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _base(text: Column) -> Column:
    none = F.expr(f"cast(array() as {_SPANS})")
    found = []
    for order, kind in enumerate(KINDS):
        pattern = F.lit(PATTERNS[kind])
        likely = text.rlike(PATTERNS[kind]) if _SIGN[kind] is None else text.contains(_SIGN[kind]) & text.rlike(PATTERNS[kind])
        found.append(F.when(likely, _kept(kind, _located(text, pattern, kind, order))).otherwise(none))
    return F.array_sort(F.concat(*found))


def _spelled(text: Column) -> Column:
    return F.split(F.translate(text, _PUNCTUATION, " " * len(_PUNCTUATION)), " ")


def _words(text: Column) -> Column:
    return _spelled(F.lower(text))


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(_digits(span["value"]))
    return F.concat_ws(":", span["kind"], value)


_MARK = "\x00"  # begins the word that stands for an entity
_PARAGRAPH = r"\n[ \t\r\x0b\x0c]*\n"


def _with_marks(text: Column, spans: str) -> Column:
    """``text`` with each base span replaced by one word that names its entity."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.concat(state["out"], F.translate(gap, _MARK, "\x01"), F.lit(" " + _MARK), F.hex(_entity(span)), F.lit(" ")).alias("out"),
        )

    rest = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.translate(F.substring(text, s["at"] + 1, F.length(text)), _MARK, "\x01")))
    return F.when(F.size(spans) == 0, F.translate(text, _MARK, "\x01")).otherwise(rest)


def _sketch(words: Column) -> Column:
    """The least hash of three words that follow one another: equal for copies, mostly for near copies."""
    start = F.struct(F.lit("").alias("a"), F.lit("").alias("b"), F.lit((1 << 63) - 1).alias("least"))

    def step(state: Column, word: Column) -> Column:
        return F.struct(state["b"].alias("a"), word.alias("b"), F.least(state["least"], F.xxhash64(state["a"], state["b"], word)).alias("least"))

    return F.aggregate(words, start, step, lambda s: s["least"])


def disclosing_terms(found: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, contexts: int = CONTEXTS) -> DataFrame:
    """(entity, term, disclosure) over the corpus: ``found`` has text and base spans of all rows."""

    def words(text: Column) -> Column:
        return F.filter(_words(text), lambda w: w != "")

    def around(w: Column, i: Column) -> Column:
        near = F.xxhash64(F.array_join(F.slice("words", F.greatest(i + 1 - window, F.lit(1)), 2 * window + 1), " "))
        return F.struct(w.alias("entity"), F.when(w.startswith(_MARK), near).alias("key"))

    marked = found.select(_with_marks(F.col("text"), "spans").alias("text"), (F.size("spans") > 0).alias("hit"))
    parts = (
        marked.filter("hit").select(_sketch(words(F.col("text"))).alias("whole"), F.explode(F.split("text", _PARAGRAPH)).alias("part"))
        .filter(F.col("part").contains(_MARK)).withColumn("part_id", F.monotonically_increasing_id())
    )
    lines = shared.stored(parts.select("part_id", "whole", F.explode(F.split("part", "\n")).alias("line")).select("part_id", "whole", words(F.col("line")).alias("words")))
    lines = lines.withColumn("marks", F.filter(F.transform("words", around), lambda m: m["key"].isNotNull()))
    # an entity with fewer keys in all has no term of enough contexts
    marks = lines.select("part_id", "whole", F.explode("marks").alias("mark")).select("part_id", "mark.entity", F.explode(F.array("mark.key", "whole")).alias("key"))
    supported = shared.stored(
        marks.groupBy("entity", "key").agg(F.count("*").alias("n")).groupBy("entity").agg(F.count("*").alias("keys")).filter(F.col("keys") >= contexts).select("entity")
    )
    held = shared.stored(marks.select("part_id", "entity").distinct().join(supported, "entity"))
    lengths = lines.groupBy("part_id").agg(F.sum(F.size("words") - F.size("marks")).alias("n_words"))
    sizes = held.join(lengths, "part_id").groupBy("entity").agg(F.sum("n_words").alias("near"))
    own = F.array_min(F.transform(F.filter("marks", lambda m: m["entity"] == F.col("entity")), lambda m: m["key"]))
    candidates = (
        lines.join(held.groupBy("part_id").agg(F.collect_list("entity").alias("entities")), "part_id")
        .select("whole", "words", "marks", F.explode("entities").alias("entity"))
        .select("entity", F.coalesce(own, "whole").alias("context"), F.explode("words").alias("term"))
        .filter(F.col("term").rlike(r"^[\p{L}\p{N}'_-]{2,}$"))
        .groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
        .filter(F.col("contexts") >= contexts)
    )
    candidates = shared.stored(candidates)
    every = marked.select(F.explode(_words(F.col("text"))).alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith(_MARK))
    counts = shared.stored(every.groupBy("term").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    information = -F.log2(F.col("near") / F.greatest(F.col("total"), F.col("near") + 1))
    share = F.col("together") / F.col("n")
    return (
        candidates.join(counts, "term").join(sizes, "entity").join(F.broadcast(total))
        .withColumn("disclosure", 1 + F.log2(share) / information).filter(F.col("disclosure") >= threshold)
        .select(F.decode(F.unhex(F.substring("entity", 2, 1 << 30)), "UTF-8").alias("entity"), "term", "disclosure")
    )


def find(docs: DataFrame, text_column: str = "text", window: int = WINDOW, threshold: float = THRESHOLD, contexts: int = CONTEXTS,
         keep_text: bool = False) -> DataFrame:
    """``docs`` without its text, and with ``pii_base`` and ``pii_spans``, arrays of (start, kind_order, end, kind, value).

    ``pii_base`` holds the pattern spans, ``pii_spans`` these and the disclosing terms, by start, then kind. With
    ``keep_text`` the text stays, as column ``pii_text``. Null and empty texts have no spans. Rows keep their
    number and all other columns, also null and repeated ids, because no row is joined by its id; columns named pii_… are replaced.
    """
    others = [c for c in docs.columns if c != text_column and not c.startswith("pii_")]
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = docs.select(*(F.col(f"`{c}`") for c in others), text.alias("pii_text"), _base(text).alias("pii_base"))
    found = shared.stored(found.withColumn("pii_row", F.monotonically_increasing_id()))  # a stored row number stays
    terms = disclosing_terms(found.select(F.col("pii_text").alias("text"), F.col("pii_base").alias("spans")), window, threshold, contexts)
    words = shared.stored(terms.select("term").distinct())
    marked = found.withColumn("pii_spans", F.col("pii_base")) if words.isEmpty() else _marked(found, words)
    columns = [*others, *(["pii_text"] if keep_text else []), "pii_base", "pii_spans"]
    return marked.select(*(F.col(f"`{c}`") for c in columns))


def _few(df: DataFrame, weight: Column, most: int = 100_000) -> DataFrame:
    """``df`` for broadcasting if its summed ``weight`` is small, else unchanged, for a shuffle join."""
    return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= most else df


def _marked(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``pii_spans``: every row is searched for the terms that it holds, as it spells them, with or without an entity."""
    held = (
        found.select("pii_row", F.explode(F.array_distinct(_spelled(F.col("pii_text")))).alias("spelled"))
        .withColumn("term", F.lower("spelled")).join(_few(words, F.lit(1)), "term")
        .groupBy("pii_row").agg(F.sort_array(F.collect_set("spelled"), asc=False).alias("terms"))
    )
    held = shared.stored(held)
    quoted = F.array_join(F.transform("terms", lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))), "|")
    edge = r"[\s" + "".join(f"\\{c}" for c in _PUNCTUATION if not c.isspace()) + "]"
    pattern = F.concat(F.lit(rf"(?:(?<={edge})|^)(?:"), quoted, F.lit(rf")(?={edge}|$)"))
    return found.join(_few(held, F.size("terms")), "pii_row", "left").withColumn(
        "pii_spans",
        F.when(F.col("terms").isNull(), F.col("pii_base")).otherwise(F.array_sort(F.concat(
            "pii_base",
            F.filter(
                _located(F.col("pii_text"), pattern, TERM, len(KINDS)),
                lambda t: ~F.exists("pii_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
            ),
        ))),
    )


def described(spans: Column) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def replacement(span: Column) -> Column:
    """Base spans become their kind; a disclosing term becomes its class: a number or a word."""
    return F.when(span["kind"] != TERM, F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))).when(
        span["value"].rlike("[0-9]"), F.lit("[NUMBER]")
    ).otherwise(F.lit("[WORD]"))


def sanitize(docs: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with spans replaced in its text; overlapping spans are replaced once. A null text stays null."""
    others = [c for c in docs.columns if c != text_column]
    flag = "is_null_" + "_" * max((len(c) for c in others), default=0)  # longer than any other name
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others), F.col(text_column).isNull().alias(flag)).alias("row"), F.col(text_column).alias("text")
    )
    found = find(packed, keep_text=True, **options)
    text = F.col("pii_text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        new = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(new, F.concat(state["out"], gap, replacement(span))).otherwise(state["out"]).alias("out"),
        )

    rebuilt = F.aggregate("pii_spans", start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    out = F.when(F.col("row").getField(flag), F.lit(None)).when(F.size("pii_spans") == 0, text).otherwise(rebuilt)
    return found.select(*(out.alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms of each row."""
    found = find(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    counts = [_of_kind(k, "pii_base").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(described(F.col("pii_base")), 256).alias("base_sha256"), described(F.col("pii_spans")).alias("spans"),
        _of_kind(TERM, "pii_spans").alias("n_terms"),
    )
