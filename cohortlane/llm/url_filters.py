"""Evaluation of captured URLs against dated lists, as the lists stood when each capture was fetched.

List entries are dated additions and removals. Per list, kind and key they become validity intervals; an as-of join gives each
capture the intervals that hold its fetch time. Intervals and captures meet by key and month: an interval stands in each month
that it covers within the captures' time span, so a key with many intervals is not compared with all captures of that key.
Kinds: ``domain`` matches a host and all its subdomains, ``host`` that host only, ``prefix`` host and path up to a ``/``, ``url`` the
whole address without its fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

KINDS = ("domain", "host", "prefix", "url")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def _keys(url: Column) -> Column:
    """array<struct<kind, key>> of everything that may be listed for a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(
        F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat_ws("/", host, F.array_join(F.slice(steps, 1, k), "/")))
    ).otherwise(F.expr("cast(array() as array<string>)"))

    def of(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    whole = F.concat(host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1))
    found = F.concat(of("domain", domains), of("host", F.array(host)), of("prefix", prefixes), of("url", F.array(whole)))
    return F.when(host != "", F.array_distinct(found)).otherwise(F.expr("cast(array() as array<struct<kind:string,key:string>>)"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, effect, kind, key, valid_from, valid_to) from entries (list_name, effect, kind, key, action, at).

    ``action`` is add or remove, ``effect`` block or allow. valid_to is exclusive, null while nothing follows. Repeated additions continue an
    interval; of an addition and a removal at one time the removal counts. Entries with a null in any of these columns are ignored.
    """
    key = ["list_name", "effect", "kind", "key"]
    at = entries.select(*key, "action", "at").dropna().groupBy(*key, "at").agg(F.max("action").alias("action"))  # add < remove
    order = Window.partitionBy(*key).orderBy("at")
    changes = at.withColumn("before", F.lag("action").over(order)).filter(F.col("before").isNull() | (F.col("before") != F.col("action")))
    ended = changes.withColumn("valid_to", F.lead("at").over(order))
    return ended.filter("action = 'add'").select(*key, F.col("at").alias("valid_from"), "valid_to")


def _month(at: Column) -> Column:
    return F.year(at) * 12 + F.month(at)


def judge(captures: DataFrame, entries: DataFrame, url_column: str = "url", time_column: str = "fetched") -> DataFrame:
    """``captures`` with n_block, n_allow, lists (active lists that match, sorted, comma-joined) and verdict.

    n_block and n_allow count active intervals that match. verdict is ``allow`` if an allow entry is active, else ``block`` if a block entry
    is, else ``none``. A null or unreadable URL, or a null time, matches nothing. Repeated captures stay; columns of ``captures`` with
    the names of the new ones are replaced.
    """
    new = ("n_block", "n_allow", "lists", "verdict")
    rows = captures.select(F.struct(*(F.col(f"`{c}`") for c in captures.columns if c not in new)).alias("row"), F.col(url_column).alias("url"), F.col(time_column).cast("timestamp").alias("t"))
    rows = shared.stored(rows.withColumn("capture", F.monotonically_increasing_id()))
    span = F.broadcast(rows.agg(F.min("t").alias("first"), F.max("t").alias("last")))  # one row
    dated = (
        intervals(entries).join(span).filter("valid_from <= last and coalesce(valid_to > first, true)")
        .withColumn("month", F.explode(F.sequence(_month(F.greatest("valid_from", "first")), _month(F.least(F.coalesce("valid_to", "last"), F.col("last"))))))
        .drop("first", "last")
    )
    asked = rows.dropna(subset=["url", "t"]).select("capture", "t", _month(F.col("t")).alias("month"), F.explode(_keys(F.col("url"))).alias("k")).select(
        "capture", "t", "month", F.col("k.kind").alias("kind"), F.col("k.key").alias("key")
    )
    hits = (
        asked.join(dated, ["kind", "key", "month"]).filter("valid_from <= t and coalesce(t < valid_to, true)")
        .groupBy("capture").agg(
            F.count_if(F.col("effect") == "block").alias("n_block"), F.count_if(F.col("effect") == "allow").alias("n_allow"),
            F.array_join(F.sort_array(F.collect_set("list_name")), ",").alias("lists"),
        )
    )
    return rows.join(hits, "capture", "left").select(
        "row.*", F.coalesce("n_block", F.lit(0)).alias("n_block"), F.coalesce("n_allow", F.lit(0)).alias("n_allow"), F.coalesce("lists", F.lit("")).alias("lists"),
        F.when(F.col("n_allow") > 0, "allow").when(F.col("n_block") > 0, "block").otherwise("none").alias("verdict"),
    )
