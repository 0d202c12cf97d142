"""Merkle manifest of a table: a hash tree per group, one over the groups, and a proof for every row.

Rows are ranked in their group by ranges, and the digits of the rank to base ``ARITY`` are grouped away one after the
other: the lowest digit gives nodes that nest the structs of their children, the next one nodes that nest those, up to
blocks of ``ARITY ** LEVELS`` ranks. One shuffle by block serves all these groupings. The blocks of a group are rows of the
next tier, which has ``ARITY ** LEVELS`` times fewer of them, and so on to one node per group; the groups are the leaves
of a tree of the same kind. On the way back each block gets what lies above it by one more grouping, and transform and
explode unfold it: every child takes the hashes to its left and right along. So no row is joined with a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ARITY = 8
LEVELS = 3
BLOCK = ARITY**LEVELS
HEX = 64
_STEP = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the text form, a colon and the text form."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return digest(*[field(c) for c in columns])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rolled_up(nodes: DataFrame) -> DataFrame:
    """Blocks (grp, block, tree) of nodes (grp, rank, node): ``tree`` nests nodes of (hash, alone, kids), ``LEVELS`` deep.

    A node that is alone in its group keeps its hash; ``alone`` says so. That is when it is the only child of the first parent.
    """
    digits = [f"d{k}" for k in range(LEVELS)]
    rows = nodes.select("grp", F.expr(f"rank div {BLOCK}").alias("block"), *(F.expr(f"rank div {ARITY**k} % {ARITY}").alias(d) for k, d in enumerate(digits)), "node")
    rows = rows.repartition("grp", "block")
    for k, digit in enumerate(digits):
        left = digits[k + 1 :]
        first = F.col("block") == 0
        for name in left:
            first &= F.col(name) == 0
        rows = rows.groupBy("grp", "block", *left).agg(F.sort_array(F.collect_list(F.struct(digit, "node"))).alias("kids"))
        rows = rows.withColumn("kids", F.transform("kids", lambda x: x["node"])).withColumn("alone", first & (F.size("kids") == 1))
        own = F.when(F.col("alone"), F.col("kids")[0]["hash"]).otherwise(F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256))
        rows = rows.select("grp", "block", *left, F.struct(own.alias("hash"), "alone", "kids").alias("node"))
    return rows.withColumnRenamed("node", "tree")


def _unfolded(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, rank, node, path, tops) of all nodes under the blocks; ``path`` lists the siblings from the node upwards.

    ``above`` has the path and the tops (hashes that rows show later) of each block; it meets its block in a grouping of both.
    """
    kinds = dict(above.dtypes)
    both = blocks.select("grp", "block", "tree", F.lit(None).cast(kinds["path"]).alias("path"), F.lit(None).cast(kinds["tops"]).alias("tops"))
    both = both.unionByName(above.select("grp", "block", F.lit(None).cast(blocks.schema["tree"].dataType).alias("tree"), "path", "tops"))
    rows = both.groupBy("grp", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("tree", "path", "tops")))
    rows = rows.select("grp", F.col("block").alias("rank"), F.col("tree").alias("node"), "path", "tops")
    for _ in range(LEVELS):
        rows = rows.withColumn("all", F.array_join(F.transform("node.kids", lambda x: x["hash"]), ""))
        rows = rows.select(
            "grp", "rank", "path", "tops", F.col("node.alone").alias("alone"),
            F.explode(F.transform("node.kids", lambda x, i: F.struct(
                x.alias("node"), i.alias("i"), F.col("all").substr(F.lit(1), i * HEX).alias("left"), F.col("all").substr((i + 1) * HEX + 1, F.lit(ARITY * HEX)).alias("right")
            ))).alias("kid"),
        )
        step = F.array(F.struct("kid.left", "kid.right"))
        rows = rows.select(
            "grp", (F.col("rank") * ARITY + F.col("kid.i")).alias("rank"), F.col("kid.node").alias("node"),
            F.when(F.col("alone"), F.col("path")).otherwise(F.concat(step, "path")).alias("path"), "tops",
        )
    return rows


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Stored blocks of all tiers; the last tier has one block per group. Only the largest rank reaches the driver, once."""
    tiers = [shared.stored(_rolled_up(nodes))]
    most = tiers[0].agg(F.max("block")).first()[0] or 0
    while most > 0:
        most //= BLOCK
        tiers.append(shared.stored(_rolled_up(tiers[-1].select("grp", F.col("block").alias("rank"), F.struct(F.col("tree.hash").alias("hash")).alias("node")))))
    return tiers


def _with_paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes below the first tier, given (grp, path, tops) of each group."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers[1:]):
        above = _unfolded(tier, above).select("grp", F.col("rank").alias("block"), "path", "tops")
    return _unfolded(tiers[0], above)


def prove(leaves: DataFrame, group: str, order: list[str], leaf: str, tampered: str | None = None) -> DataFrame:
    """``leaves`` with subroot, root, proof_sha256, folded_root and verified.

    Leaves of each value of ``group`` ascend by ``order`` and then ``leaf``; nulls come first, in ``group`` too, whose values
    are ordered by their UTF-8 bytes. Every ``ARITY`` nodes in a row become their digest (a last run has fewer, even one) until one is
    left: the group's subroot, which is a leaf of the tree over the groups, whose last node is the root. ``proof_sha256`` is
    the digest of all siblings from the leaf to the root. ``folded_root`` is computed from ``tampered``, where that column is not null,
    else from the leaf, and the siblings; ``verified`` compares it with the root. Rows that are equal in all these columns
    are leaves of their own. An empty table gives an empty table. The result has the columns of ``leaves`` and the new ones;
    a column of ``leaves`` with one of their names is an error. Blocks carry the columns of their rows, so texts stay out of ``leaves``.
    """
    new = ("subroot", "root", "proof_sha256", "folded_root", "verified")
    clash = [c for c in new if c in leaves.columns]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("="), F.sha2(F.col(group).cast("string"), 256)), F.lit("-")).alias("grp"), F.col(group).alias("value"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)),
        F.col(leaf).alias("leaf"), (F.col(tampered) if tampered else F.lit(None).cast("string")).alias("tampered"), F.struct(*leaves.columns).alias("row"),
    )
    rows = shared.stored(rows)  # else finding the ranges would hash the texts again
    ranked = shared.running(rows, ["grp"], [*(f"o{k}" for k in range(len(order))), "leaf"], "rank")
    tiers = _tiers(ranked.select("grp", "rank", F.struct(F.col("leaf").alias("hash"), "tampered", "row").alias("node")))
    values = rows.groupBy("grp").agg(F.first("value").alias("value"))
    # every group has one block in the last tier; its name and its subroot meet by a grouping
    tops = tiers[-1].select("grp", F.col("tree.hash").alias("subroot"), F.lit(None).cast(rows.schema["value"].dataType).alias("value"))
    named = tops.unionByName(values.select("grp", F.lit(None).cast("string").alias("subroot"), "value"))
    groups = shared.stored(named.groupBy("grp").agg(F.max("subroot").alias("subroot"), F.max("value").alias("value")).withColumn("forest", F.lit("forest")))
    order_of_groups = shared.running(groups, ["forest"], ["value"], "rank")
    forest = _tiers(order_of_groups.select(F.col("forest").alias("grp"), "rank", F.struct(F.col("subroot").alias("hash"), F.col("grp").alias("of")).alias("node")))
    roots = forest[-1].select("grp", F.array().cast(_STEP).alias("path"), F.struct(F.col("tree.hash").alias("root")).alias("tops"))
    above = _with_paths(forest, roots).select(
        F.col("node.of").alias("grp"), "path", F.struct(F.col("tops.root").alias("root"), F.col("node.hash").alias("subroot")).alias("tops")
    )
    found = _with_paths(tiers, above)
    folded = F.aggregate("path", F.coalesce("node.tampered", "node.hash"), lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""), 256)
    return found.select(
        "node.row.*", F.col("tops.subroot").alias("subroot"), F.col("tops.root").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of ``docs``.

    A leaf is the digest of ``fields`` (doc_id, source, lang, n_chars, text). For the check of the proofs, rows whose id has a CRC-32 that
    3 divides are tampered with: their texts' A-Z are in lower case. A null text and a null id are left alone. Rows of one id are leaves
    of their own, in the order of their leaves; null ids come first. Other columns are not read.
    """
    fields = fields or ["doc_id", "source", "lang", "n_chars", "text"]
    plain = [F.col(c) for c in fields]
    changed = [lower_ascii(F.col(c)) if c == text_column else F.col(c) for c in fields]
    chosen = F.crc32(F.col(id_column).cast("string")) % 3 == 0
    leaves = docs.select(
        F.col(id_column).alias("doc_id"), F.col(group).alias("_group"), leaf_of(plain).alias("leaf"), F.when(chosen, leaf_of(changed)).alias("_tampered")
    )
    out = prove(leaves, "_group", ["doc_id"], "leaf", "_tampered")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
