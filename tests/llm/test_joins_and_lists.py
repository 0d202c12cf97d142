"""Shingle join and URL lists against plain versions."""

import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlane.llm import ngram_join, shared, url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sets(rows):
    sets = defaultdict(set)
    for doc, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets[doc] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def plain_components(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def corpus(seed):
    """Copies, chains of edits, shared passages, short, empty and very long texts."""
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(draw.choices(words, k=30))
    texts = []
    for _ in range(12):
        base = draw.choices(words, k=draw.randint(6, 90))
        for _ in range(draw.randint(1, 9)):
            texts.append(" ".join(base))
            base = [draw.choice(words) if draw.random() < 0.02 else w for w in base]
        texts.append(passage + " " + " ".join(base))
    texts += ["", None, "  \n ", "one", "ONE", "one two three four", "a b c d e", "A\tB\nC d\x0be", passage, passage, " ".join(draw.choices(words, k=3000)), "é" * 5000]
    draw.shuffle(texts)
    return list(enumerate(texts, 3))


def test_components_equal_those_of_all_pairs(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shingle", F.lit(1)).withColumn("component", F.lit("x")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == plain_components(plain_sets(rows))


def test_shingles_are_dealt_in_shares(spark, monkeypatch):
    tables, store = [], shared.stored

    def watched(df):
        out = store(df)
        if "p_pos" in df.columns:
            tables.append({r.shingle for r in out.select("shingle").distinct().collect()})
        assert "segment" not in df.columns or not tables  # counters are gone by then
        return out

    monkeypatch.setattr(shared, "stored", watched)
    rows = corpus(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(plain_sets(rows))
    assert len(tables) == ngram_join.SHARES and all(tables)
    assert sum(map(len, tables)) == len(set().union(*tables))


def test_places_that_no_pair_can_have_are_not_kept(spark, monkeypatch):
    """A long text of five passages, of which each is a text too, shares prefix shingles with texts of other sizes only."""
    places, store = [], shared.stored

    def watched(df):
        out = store(df)
        if "p_pos" in df.columns:
            places.extend(out.collect())
        return out

    monkeypatch.setattr(shared, "stored", watched)
    passages = [" ".join(f"p{k}x{n}" for n in range(40)) for k in range(5)]
    near = " ".join(f"n{n}" for n in range(50))
    rows = [*enumerate(passages, 1), (9, " ".join(passages)), (20, near), (21, near + " more")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(plain_sets(rows))
    assert {r.doc_id for r in places} == {r.p_id for r in places} | {20, 21} == {20, 21}


def test_places_keep_both_sides_of_every_possible_pair(spark):
    draw = random.Random(5)
    rows = [(s, d, n, draw.randrange(n - -(-3 * n // 4) + 1)) for s in range(60) for d in range(draw.randint(1, 7)) for n in [draw.choice([1, 2, 5, 9, 12, 16, 21, 28, 90])]]
    table = spark.createDataFrame(rows, "shingle long, doc_id long, n int, pos int").repartition(3)
    kept = {tuple(r)[:4]: r.p_id for r in ngram_join._with_pivot(table, ngram_join.SIMILARITY).collect()}
    x, y = (table.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "n", "pos"))) for side in "xy")
    pairs = x.join(y, "shingle").filter("x_doc_id <> y_doc_id").filter(ngram_join._possible(ngram_join.SIMILARITY)).collect()
    sides = {(r.shingle, r.x_doc_id, r.x_n, r.x_pos) for r in pairs}
    assert sides and sides <= set(kept) < set(rows)
    assert all(len({p for k, p in kept.items() if k[0] == s}) == 1 for s in {k[0] for k in kept})


def test_batches_only_get_smaller(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(1)
    shared.smaller_batches(docs)
    shared.smaller_batches(docs, ngram_join.BATCH_ROWS, ngram_join.BATCH_BYTES)
    shared.smaller_batches(docs)
    assert int(spark.conf.get(rows)) <= ngram_join.BATCH_ROWS
    assert int(spark.conf.get(size).removesuffix("b")) <= ngram_join.BATCH_BYTES


def test_repeated_and_null_ids_and_an_empty_table(spark):
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (2, text + " i"), (None, text), (None, None), (4, "q r s t u v"), (9, "q r s t u v")]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == [(1, 1), (1, 1), (2, 1), (4, 4), (9, 4)]
    assert [(r.component_id, r.class_id) for r in found if r.doc_id is None] == [(None, None)] * 2
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark):
    draw = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(150):
        at = draw.randrange(60)
        rows.append((k, " ".join(base[:at] + [f"x{k}"] + base[at + 1 :])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_components(plain_sets(rows))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r.id: r.component for r in shared.components(edges).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def plain_verdict(url, at, entries):
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*([^?#]*)([^#]*)", url or "")
    if not m or at is None:
        return ("none", "")
    host, path = m[1].lower().rstrip("."), m[2]
    active = []
    state = {}
    for name, effect, kind, key, action, when in sorted((e for e in entries if None not in e), key=lambda e: (e[5], e[4])):
        if when <= at:
            state[name, effect, kind, key] = action
    for (name, effect, kind, key), action in state.items():
        full = "/".join([host, *[s for s in path.split("/") if s]])
        hit = {"domain": host == key or host.endswith("." + key), "host": host == key, "prefix": full == key or full.startswith(key + "/"), "url": host + path + m[3] == key}[kind]
        if action == "add" and hit and not (kind == "prefix" and "/" not in key):
            active.append((name, effect))
    effects = {e for _, e in active}
    return ("allow" if "allow" in effects else "block" if "block" in effects else "none", ",".join(sorted({n for n, _ in active})))


def test_verdicts_follow_the_lists_as_they_stood(spark):
    draw = random.Random(3)
    day = lambda k: dt.datetime(2023, 11, 1) + dt.timedelta(hours=7 * k)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "x.org", "www.x.org"]
    entries = [
        (f"list{draw.randint(1, 3)}", draw.choice(["block", "block", "allow"]), kind, key, draw.choice(["add", "add", "remove"]), day(draw.randint(0, 200)))
        for _ in range(120)
        for kind, key in [draw.choice([("domain", draw.choice(hosts)), ("host", draw.choice(hosts)), ("prefix", draw.choice(hosts) + "/en"), ("url", "x.org/en/1?a=b")])]
    ]
    entries += [entries[0], ("list1", "block", "host", None, "add", day(1)), (None, "block", "host", "x.org", "add", day(1))]
    urls = [f"http{s}://{h}{p}" for s in ("", "s") for h in (*hosts, "X.ORG.", "me:pw@x.org:8080") for p in ("", "/", "/en", "/en/1?a=b#top", "/english")] + ["", None, "not a url", "mailto:a@x.org"]
    captures = [(k, draw.choice(urls), day(draw.randint(-20, 230)) if k % 31 else None) for k in range(600)]
    captures += captures[:5]
    table = spark.createDataFrame(captures, "page_id long, url string, fetched timestamp").withColumn("month", F.lit(1)).withColumn("verdict", F.lit("old"))
    got = url_filters.judge(table, spark.createDataFrame(entries, "list_name string, effect string, kind string, key string, action string, at timestamp"))
    assert got.columns == ["page_id", "url", "fetched", "month", "n_block", "n_allow", "lists", "verdict"]
    expected = sorted((k, *plain_verdict(u, t, entries)) for k, u, t in captures)
    assert sorted((r.page_id, r.verdict, r.lists) for r in got.collect()) == expected
    assert len({v for _, v, _ in expected}) == 3


@pytest.mark.parametrize("empty", ["captures", "entries"])
def test_empty_lists_and_captures(spark, empty):
    captures = spark.createDataFrame([(1, "http://a.b/", dt.datetime(2024, 1, 1))][: empty == "entries"], "page_id long, url string, fetched timestamp")
    entries = spark.createDataFrame([("l", "block", "host", "a.b", "add", dt.datetime(2023, 1, 1))][: empty == "captures"], "list_name string, effect string, kind string, key string, action string, at timestamp")
    assert [r.verdict for r in url_filters.judge(captures, entries).collect()] == ["none"] * (empty == "entries")


def test_links_are_named_as_checked_ones(spark):
    """Links within a component are not all verified, so their number is no degree."""
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x y")], "doc_id long, text string")
    assert ngram_join.jaccard_components(docs).columns == ["doc_id", "n_shingles", "component_id", "class_id", "n_checked_links"]
