"""Token counts against the library, hash trees and prefix tries against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlane.llm import manifest, prefix_trie, shared, token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# --- token counts -------------------------------------------------------------------------------------------------


def odd_texts(seed, n):
    draw = random.Random(seed)
    parts = ["a", "b", "'s", "'re", "'LL", " ", "1", "é", "Σ", "́", "İ", "<|endoftext|>", "<|startoftext|>", "<|end", "中", "'", "!", "\n", "\u0085", " ", "\U0001f600", "ﬁ"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(n)] + [
        "", None, "  \n", "it's  can't we'LL they'Re i'd ''s '' 's 'r 'v", "a" * 5000, "ab" * 3000, "aaa aaaa aaaaa", "é" * 3000 + "'s", "e<|endoftext|>́ é",
        "".join(draw.choice("abcdefghij") for _ in range(20_000)), "word " * 30_000, "ΑΣ ΟΔΟΣ Σ", "१२३ ①② ǅ ß ẞ",
    ]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_those_of_the_library(spark, name):
    path = public_tokenizers.path(name)
    rows = list(enumerate(odd_texts(1, 300))) + [(3, "one id twice"), (None, "no id")]
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, n_tokens string, over_limit int")
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, path).collect()), key=repr)
    want = []
    for k, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((k, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    total = token_counts.totals(token_counts.count_tokens(docs, path)).first()
    assert total.n_docs == len(rows) and total.n_tokens == sum(w[2] for w in want) and total.n_over_limit == sum(w[3] for w in want)


def test_code_points_are_cut_as_the_library_cuts_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.merger(path)
    points = "".join(chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    texts = ["".join(f"{c}{c}x{c} " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    assert counter.count(texts).tolist() == [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]


def test_ranges_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(shared, "range_hashes", lambda data, starts, ends, values: (ends - starts).astype(np.uint64))
    counter = token_counts.merger(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["the cat zqx saw the dog", "qqq zzz the"]
    assert counter.count(texts).tolist() == [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]


def test_long_sequences_and_rounds_agree():
    counter = token_counts.merger(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(4)
    for letters in ("ab", "the", "etaoinshrdlu"):
        data = np.frombuffer("".join(draw.choice(letters) for _ in range(1500)).encode(), np.uint8)
        assert counter.merged(data, np.array([0]), np.array([len(data)]))[0] == counter._swept(data)


# --- hash trees ---------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(hashes):
    """The last node and the siblings of each leaf, upwards."""
    paths, under = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        above, under_above = [], []
        for at in range(0, len(hashes), 8):
            run = hashes[at : at + 8]
            above.append(sha(*run))
            under_above.append([])
            for k in range(len(run)):
                for leaf in under[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
                    under_above[-1].append(leaf)
        hashes, under = above, under_above
    return hashes[0], paths


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((sha(*map(field, row)), row))
    trees = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        members = sorted(groups[lang], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append((members, *plain_tree([m[0] for m in members])))
    if not trees:
        return []
    root, tops = plain_tree([t[1] for t in trees])
    out = []
    for (members, subroot, paths), top in zip(trees, tops):
        for (leaf, row), path in zip(members, paths):
            path, folded = path + top, leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                folded = sha(*map(field, (*row[:4], row[4] and row[4].translate(LOWER))))
            for left, right in path:
                folded = sha(left, folded, right)
            out.append((row[0], leaf, subroot, root, sha(*[a + b for a, b in path]), folded, folded == root))
    return out


def trees_of(seed):
    draw = random.Random(seed)
    yield []
    yield [(5, "s", "en", 3, "Abc")]
    rows = [(k, draw.choice(["s", None]), draw.choice(["en"] * 9 + ["de", None, "", "é"]), k, draw.choice(["Abc", "xyz", None, "", "É Ä"])) for k in range(1200)]
    yield rows + [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "Dup")] * 600  # more than a block, many of them equal
    yield [(k, "s", f"l{k:03d}", k, "T" * k) for k in range(600)]  # more groups than a block has


@pytest.mark.parametrize("case", range(4))
def test_manifest_equals_the_plain_tree(spark, case):
    rows = list(trees_of(2))[case]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs = docs.select("*", F.lit("x").alias("leaf"), F.lit(1).alias("root"), F.lit(2).alias("grp"))
    assert sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=repr) == sorted(plain_manifest(rows), key=repr)


def test_proofs_keep_other_columns_and_reject_equal_names(spark):
    rows = spark.createDataFrame([("a", k, f"{k:064x}", None) for k in range(20)], "part string, id long, hash string, other string")
    out = manifest.prove(rows, "part", ["id"], "hash")
    assert out.columns == [*rows.columns, "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.filter("verified").count() == 20
    with pytest.raises(ValueError, match="root"):
        manifest.prove(rows.withColumnRenamed("other", "root"), "part", ["id"], "hash")


def test_running_values_cross_ranges(spark):
    rows = [(k % 3 if k < 900 else 0, k // 2, k * 7919 % 1009) for k in range(2000)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one range
    try:
        got = shared.running(df, ["g"], ["o", "v"], "place", {"x": "v"}, {"s": "v"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for g in range(3):
        x = s = 0
        for place, (_, o, v) in enumerate(sorted(r for r in rows if r[0] == g)):
            x, s = x ^ v, s + v
            want.append((g, o, v, place, x, s))
    assert sorted(tuple(r) for r in got) == sorted(want)


# --- prefix tries -------------------------------------------------------------------------------------------------


def plain_trie(rows):
    """Nodes of the rebuilt conversations by definition; ties of a turn by the digest of role and text."""
    told = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told.setdefault(conv, []).append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}")[:30], role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in told.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        under = [out[k] for k in children.get(node, [])]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(u["saved"] for u in under)
        out[node] = {"leaves": sum(u["leaves"] for u in under) or 1, "saved": saved}
    return [
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, [])), out[node]["leaves"], out[node]["saved"],
         sha(",".join(str(c) for c in sorted(m) if built[c] == node)))
        for node, m in members.items()
    ]


def conversations(seed):
    draw = random.Random(seed)
    yield []
    yield [(5, None, None, None)]
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(215, 230), 10**15 + 7]:
        rows += [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bb", "", None, "é"])) for t in range(draw.randrange(1, 9))]
    copied = [(t, "user", f"line {t}") for t in range(5)]
    rows += [(c, *turn) for c in range(300, 400) for turn in copied]  # a large group of copies
    rows += [(7, None, "user", "x"), (7, None, "user", "x"), (7, 2, "user", "tie"), (7, 2, "user", "other tie"), (None, 1, "user", "no conversation")]
    rows += [(1, t, "user", f"long {t % 7}") for t in range(10, 1500)]  # one conversation has most of the rows
    yield rows


@pytest.mark.parametrize("case", range(3))
def test_trie_equals_the_definition(spark, case):
    rows = list(conversations(5))[case]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x")).withColumn("place", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if case == 2 else "true")  # several ranges
    try:
        got = [tuple(r) for r in prefix_trie.conversation_trie(table).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=repr) == sorted(plain_trie(rows), key=repr)
