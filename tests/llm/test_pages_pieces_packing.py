"""Page texts, pieces and packing against plain versions, and the pipeline's stages on a small folder."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlane.llm import dom, html_content, packing, pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  a  b ", "▁x▁▁y", "日本語 🎉 emoji\t\n x", "a" * 3000, "Hello, world. It's <|endoftext|> 12345!", "\x00\x7f", "ab " * 5000]


def page(k):
    body = "".join(f"<p>Paragraph {j} of page {k}, with a few words &amp; a stop.</p>" for j in range(1 + k % 4))
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav>"
        f"<!-- x --><div class=\"ad\">Buy it now.</div><article><h1>Title {k}</h1>{body}</article><footer>&copy; site</footer></body></html>"
    )


def test_main_text_of_pages(spark):
    odd = [None, "", "<", "<div", "plain &lt;text&gt;", "<script>x</script>", "<p>a<br>b&nbsp; c\n d</p>", "<a href='" * 300, page(1) * 3, "<div>" * 3000 + "deep"]
    rows = [(k, f"http://x/{k}", page(k)) for k in range(60)] + [(1000 + k, None, t) for k, t in enumerate(odd)] + [(None, "u", page(3)), (3, "u", page(3))]
    got = html_content.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        if r.page_id is not None and r.page_id < 60:
            assert r.text == "\n".join([f"Title {r.page_id}", *(f"Paragraph {j} of page {r.page_id}, with a few words & a stop." for j in range(1 + r.page_id % 4))])
    assert [r.text for r in got if r.page_id in (1000, 1001, 1005)] == ["", "", ""]
    empty = html_content.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0


def test_elements_without_an_end_tag_hide_nothing():
    def texts(page):
        return [t for t in dom.tree_of(page).text if t is not None]

    for name in ("button", "object", "math", "svg", "video", "audio", "canvas", "select", "noscript", "template"):
        assert texts(f"<p>a</p><{name} x=1><p>b</p><div>c</div>") == ["a", "b", "c"]
        assert texts(f"<{name}><p>b</p><{name} x>{'' if name in ('object', 'math') else 'out'}</{name}><p>c</p>") == ["b", "c"]  # the end tag is another's
    for name in ("button", "svg", "select", "noscript"):
        assert texts(f"<p>a<{name}>out</{name}> b</p>") == ["a b"]
    assert texts("<p>a</p><svg><svg>x</svg>y</svg><svg/><p>b</p>") == ["a", "b"]
    assert texts("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object data=d>text</object>.</p>") == ["Let x=1 and text."]
    for name in ("script", "style", "textarea", "title"):
        assert texts(f"<p>a</p><{name}>b<p>c</p>") == ["a"]


def test_layouts_not_trained_on():
    draw = random.Random(77)
    blocks = [[f"Sentence {j} of article {k}, which goes on for some words, and ends." for j in range(5)] for k in range(80)]
    spare = [f"other part {k} with link words" for k in range(50)]
    trees, known = [], []
    for own in blocks * 3:
        runs, html = html_content.layout(own, spare, draw)
        tree = dom.tree_of(html)
        states = dict(runs)
        trees.append(tree)
        known.append([-1 if t is None else states.get(t, -1) for t in tree.text])
    model = html_content.fit(trees[:180], known[:180])
    right = total = 0
    for tree, states in zip(trees[180:], known[180:]):
        content, _ = model.messages(html_content.forest([tree]))
        right += sum((p >= 0.5) == bool(s) for p, s in zip(content, states) if s >= 0)
        total += sum(s >= 0 for s in states)
    assert right / total > 0.97


def test_messages_give_exact_marginals():
    """Against the sum over all states of a small tree."""
    tree = dom.tree_of("<div class=a><p>x y<p>z</div><nav>m</nav>")
    draw = np.random.default_rng(0)
    model = html_content.Model(draw.standard_normal(dom.FEATURES), draw.standard_normal((dom.KINDS, 2, 2)))
    n = len(tree.parent)
    total = np.zeros(n)
    everything = 0.0
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        score = sum(model.weight[f] * y[k] for k in range(n) for f in tree.features[k])
        score += sum(model.edge[tree.kind[k], y[tree.parent[k]], y[k]] for k in range(1, n))
        everything += np.exp(score)
        total += np.exp(score) * np.array(y)
    assert np.allclose(model.messages(html_content.forest([tree]))[0], total / everything)


def best_pieces(text, scores, v):
    if not text:
        return []
    s = (" " + text).replace("▁", pieces._OWN_MARK).replace(" ", "▁")
    best, back = [0.0] + [-1e300] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for size in range(min(16, end), 0, -1):
            piece = s[end - size : end]
            if piece in scores and best[end - size] + scores[piece][0] > best[end]:
                best[end], back[end] = best[end - size] + scores[piece][0], (size, [scores[piece][1]])
        if s[end - 1] not in scores and best[end - 1] + v.unknown > best[end]:
            best[end], back[end] = best[end - 1] + v.unknown, (1, [int(v.byte[b]) for b in pieces._raw(s[end - 1])])
    out, end = [], len(s)
    while end:
        size, ids = back[end]
        out, end = ids + out, end - size
    return out


def test_pieces_have_the_best_score_and_decode(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    scores = {model.id_to_piece(k): (model.get_score(k), k) for k in range(model.vocab_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))}
    rows = list(enumerate(TEXTS)) + [(None, "x y"), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    coded = pieces.encode(docs, MODEL)
    assert coded.columns == ["doc_id", "text", "n", "piece_ids"]
    v = pieces.vocabulary(MODEL)
    for r in pieces.decode(coded, MODEL).collect():
        assert r.text_decoded == (r.text or "") and r.piece_ids == best_pieces(r.text, scores, v)
    assert all(r.round_trip for r in pieces.round_trips(docs, MODEL).collect()) and pieces.round_trips(docs.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError, match="exist"):
        pieces.encode(coded, MODEL)


def test_packing_has_the_ids_of_the_unchanged_tokenizer(spark, tmp_path):
    plain = Tokenizer.from_file(JSON)
    texts = [*TEXTS, "<|endoftext|>", "a <|endoftext|><|endoftext|>\n b <|endoftext", "<|ENDOFTEXT|>"]
    for path in (RANKS, JSON):
        coded = packing.encoder(path, packing.SPECIAL)
        assert all(list(coded(t or "")) == plain.encode(t or "", add_special_tokens=False).ids for t in texts)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.start): (r.ids_crc32, r.doc_tokens) for r in queries.op7_packing(spark, str(tmp_path)).collect()}
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert all(got[doc, k] == (zlib.crc32(ids[k : k + 2048].tobytes()), len(ids)) for k in range(0, len(ids), 2048))


def test_packing_loses_no_id_and_pads_little(spark):
    draw = random.Random(0)
    rows = list(enumerate(TEXTS + [" ".join(draw.choices(["one", "zwei", "trois", "cuatro"], k=draw.randint(1, 900))) for _ in range(150)])) + [(None, "a"), (3, "b"), (3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1)).repartition(5)
    got = packing.pack(docs, RANKS).collect()
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    expected = Counter()
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            expected[doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 2048 and sorted(by) == list(range(len(by))) and sum(2048 - s for s in sizes) < 0.05 * sum(sizes)
    assert packing.pack(docs.limit(0), RANKS).count() == 0


def test_fill_is_closest_to_capacity():
    draw = random.Random(1)
    for _ in range(200):
        counts = {draw.randint(1, 20): draw.randint(1, 3) for _ in range(4)}
        capacity = draw.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing.fill(counts, capacity)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity) and all(n <= counts[k] for k, n in chosen.items())


def test_plan_places_every_piece_once():
    counts = {3: 5, 7: 11, 10: 1, 4: 2}
    rows, sequences = packing.plan(counts, 10)
    assert sum(k * n for k, n in counts.items()) <= 10 * sequences and packing.plan({}, 10) == ([], 0)
    assert {length: max(first for k, first, *_ in rows if k == length) < n for length, n in counts.items()} == dict.fromkeys(counts, True)


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(3)
    words = ["the", "ship", "sailed", "north", "again", "under", "grey", "skies", "until", "morning"] + [f"port{k}" for k in range(200)]
    rows, labels = [], []
    for k in range(240):
        text = " ".join(draw.choices(words, k=60)) + "."
        bad = k % 5 == 0
        rows.append((k, " ".join(w + "###" for w in text.split()) if bad else text, "en" if k % 2 else "xx", "s", len(text)))
        labels.append((k, int(not bad), 0))
    rows += [(900, rows[1][1], "en", "s", 1), (901, rows[1][1] + " more", "en", "s", 1), (902, "12 34", None, None, None), (903, None, None, None, None)]
    rows += [(None, "write to me@mail.example today, " + rows[2][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, docs, str(tmp_path))
        assert following.columns == docs.columns
        following.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not kept[0] & {902, 903} and kept[1] == {k for k in kept[0] if k is None or k % 5 or k == 900} and kept[2] == kept[1] - {900, 901}
    assert docs.filter("text like '%[EMAIL]%' and text not like '%@%' and n_chars = length(text)").count() == 1
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.select("doc_id").collect()} == kept[3]


def test_registered_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 11))
