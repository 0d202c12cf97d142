"""Bit maps of keys, and texts of thousands of addresses."""

import re

from pyspark.sql import functions as F

from cohortlane.llm import pii, shared


def test_rows_among_keys(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.sql("select cast(null as long), 'n'"))
    keys = rows.select("doc_id").filter("doc_id % 50 = 0")
    wanted = set(range(0, 5000, 50))
    got = {r.doc_id for r in shared.among(rows, "doc_id", keys).collect()}
    assert wanted <= got and len(got) < 110
    assert wanted <= {r.doc_id for r in shared.among(rows, "doc_id", keys, bits=64).collect()}  # a full map keeps rows, never drops them
    assert shared.among(rows, "doc_id", keys.limit(0)).count() == 0


def test_thousands_of_addresses_in_one_text(spark):
    text = "é " + " ".join(f"u{k}@mail{k}.example" for k in range(2000)) + " end"
    docs = spark.createDataFrame([(text,)], "text string")
    spans = docs.select(pii._base(F.col("text")).alias("spans")).first().spans
    assert [(s.start, s.end) for s in spans] == [m.span() for m in re.finditer(r"u\d+@mail\d+\.example", text)]
