"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations are grouped into one weighted sequence with the list of those that end there, and only one of them
goes on. Sequences that are proper prefixes of others fall to an anti-join; what is left are the leaves. Nodes are then one
aggregation of weighted prefixes. Sums over subtrees need no walk by depth: every node belongs to one leaf, the smallest of those below it, so the
nodes of a leaf are the end of its path. A node's sum is what its own leaf holds from it downwards, and all of what the
other leaves below it hold.

A prefix is known by its depth and 128 bits, the exclusive or of the hashes of its turns with their places. Running values
come from ranges (:func:`shared.running`), so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

NODE = ["depth", "x1", "x2"]
CHUNK_BITS = 10  # end lists are built from pieces of 1,024 neighbouring ids


def _number(hexadecimal: Column, start: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(hexadecimal, start, 15), 16, 10).cast("long")


def turns_of(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, the digest of role and text as two numbers, and the code points of the text."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.filter(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.length(said).cast("long").alias("size"),
        F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256).alias("digest"),
    )
    return rows.select("conv_id", "turn", "size", _number(F.col("digest"), 1).alias("t1"), _number(F.col("digest"), 16).alias("t2"))


def rebuilt(conversations: DataFrame, family: int = 100, heads: int = 6, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, n_turns, depth, e1, e2, size) of the rebuilt conversations, and all of these (conv_id, n_turns).

    Conversation c begins with the first h turns of conversation c - c % ``family`` (all of them if it has fewer, none if it is absent),
    h being the CRC-32 of c modulo ``heads``; its own turns from the h-th on follow. Turns are ordered by ``turn``, null
    first; turns that tie are ordered by the digest of role and text. A null role or text is empty. Rows without a conversation id are left out.
    """
    turns = shared.stored(turns_of(conversations, **columns))
    placed = shared.stored(shared.running(turns, ["conv_id"], ["turn", "t1", "t2"], "place").drop("turn"))
    taken = F.crc32(F.col("conv_id").cast("string")) % heads
    first = placed.filter(F.col("place") < heads - 1).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "size"))).alias("head"))
    convs = placed.groupBy("conv_id").agg((F.max("place") + 1).alias("n_own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    convs = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    convs = convs.withColumn("kept", F.coalesce(F.slice("head", F.lit(1), taken.cast("int")), F.expr("slice(array(named_struct('place', 0L, 't1', 0L, 't2', 0L, 'size', 0L)), 1, 0)")))
    n_kept = F.size("kept").cast("long")
    convs = shared.stored(convs.select("conv_id", "kept", n_kept.alias("n_kept"), (n_kept + F.greatest(F.col("n_own") - taken, F.lit(0))).alias("n_turns")))
    borrowed = convs.select("conv_id", "n_turns", F.inline("kept")).withColumn("depth", F.col("place") + 1)
    own = placed.filter(F.col("place") >= taken).join(convs.drop("kept"), "conv_id").withColumn("depth", F.col("place") - taken + F.col("n_kept") + 1)
    columns_of = ["conv_id", "n_turns", "depth", "size", "t1", "t2"]
    rows = borrowed.select(columns_of).unionByName(own.select(columns_of))
    rows = rows.select("conv_id", "n_turns", "depth", "size", *(F.xxhash64(F.lit(k), "depth", "t1", "t2").alias(f"e{k}") for k in (1, 2)))
    return rows, convs.select("conv_id", "n_turns")


def _end_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node of pieces that come in order; only the running digest is held."""
    key, running = None, None

    def told(keys, values):
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array(values, pa.string())], names=[*NODE, "ends_sha256"])

    for batch in batches:
        keys, values = [], []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if node != key:
                if key is not None:
                    keys.append(key)
                    values.append(running.hexdigest())
                key, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        yield told(keys, values)
    if key is not None:
        yield told([key], [running.hexdigest()])


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are turns (conv_id, n_turns, depth from 1, e1, e2, size), ``convs`` all conversations (conv_id, n_turns), those without turns
    too. e1 and e2 are hashes of a turn with its depth. Every distinct sequence of first turns is a node, from the root of depth 0; conv_id
    is its smallest member, n_convs the number of members, saved_tokens the sum over its subtree of (n_convs - 1) x size of the last
    turn, ends_sha256 the digest of the comma-joined ids of members that end there. Without conversations there are no nodes.
    """
    keyed = shared.running(rows, ["conv_id"], ["depth"], "place", xors={"x1": "e1", "x2": "e2"})
    keyed = shared.stored(keyed.select(
        "conv_id", "n_turns", *NODE, F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"), "size"
    ))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    ends = keyed.filter("depth = n_turns").select("conv_id", *NODE)
    ends = ends.unionByName(convs.filter("n_turns = 0").select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2")))
    pieces = shared.stored(ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("piece")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("first"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids")
    ))
    lists = pieces.select(*NODE, "piece", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "piece").drop("piece")
    lists = lists.mapInArrow(_end_lists, "depth long, x1 long, x2 long, ends_sha256 string")
    sequences = shared.stored(pieces.groupBy(*NODE).agg(F.min("first").alias("conv_id"), F.sum("n").alias("weight")))
    prefixes = keyed.join(sequences.select("conv_id", "weight"), "conv_id").unionByName(sequences.select(
        "conv_id", F.col("depth").alias("n_turns"), zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("size"), "weight"
    ))
    prefixes = shared.stored(prefixes)
    leaves = sequences.join(prefixes.filter("depth < n_turns").select(*NODE).distinct(), NODE, "left_anti").select("conv_id", F.col("conv_id").alias("leaf"))
    nodes = shared.stored(prefixes.join(leaves, "conv_id", "left").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("leaf").alias("owner"), F.count("leaf").alias("n_leaves"),
        ((F.sum("weight") - 1) * F.max("size")).alias("saved"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), (-F.col("depth")).alias("up"),
    ))
    tailed = shared.running(nodes, ["owner"], ["up"], "place", sums={"tail": "saved"})
    lines = nodes.groupBy("owner").agg(F.sum("saved").alias("total"), F.min("depth").alias("top")).withColumnRenamed("owner", "conv_id")
    others = prefixes.join(lines, "conv_id").filter("depth < top").select(*NODE, F.col("total").alias("more"), zero.alias("child"))
    children = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), zero.alias("more"), F.lit(1).cast("long").alias("child"))
    added = others.unionByName(children).groupBy(*NODE).agg(F.sum("more").alias("more"), F.sum("child").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = tailed.join(added, NODE, "left").join(lists, NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        (F.col("tail") + F.coalesce("more", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations; empty and null cases are those of :func:`rebuilt` and :func:`trie`. Other columns are not read."""
    return trie(*rebuilt(conversations, **columns))
