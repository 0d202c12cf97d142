"""Counts, quality rules and model, languages, personal data and fingerprints on small inputs."""

import hashlib
import math
import random
import zlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import fingerprints, language_id, pii, quality_model, quality_rules, shared, textstats

ODD = [
    None, "", " \n\t", "a b c d e f g h  a b c d e f g h\n\n\na b\na b\n a b\n\n", "é é\x0b" * 40, "x " * 40, "A!! B|c #d\n<e>\n<e>\n", "日本 語\n日本 語\n",
    "word " * 9000, "z" * 200_000, "\x00\x00 \x00\n\x00\n\x00\n\x00",
]


def plain_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for k in range(len(words) - 7):
        windows[tuple(words[k : k + 8])].append(k)
    covered = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts(spark):
    table = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("n_words", F.lit("x")).repartition(2)
    got = quality_rules.judge(table.withColumn("lang", F.lit(None).cast("string")), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.doc_id: tuple(r[c] for c in textstats.BASE) for r in got} == {k: plain_counts(t) for k, t in enumerate(ODD)}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed) and r.rung is None


def test_blocks_do_not_change_counts():
    column = pa.array(ODD)
    whole = [textstats.block_counts(d, o) for _, _, d, o in shared.byte_blocks(column)]
    small = [textstats.block_counts(d, o) for _, _, d, o in shared.byte_blocks(column, 10)]
    sliced = [textstats.block_counts(d, o) for _, _, d, o in shared.byte_blocks(column.slice(3, 4), 64)]
    for c in textstats.COUNTS:
        one = np.concatenate([b[c] for b in whole])
        assert (one == np.concatenate([b[c] for b in small])).all() and (one[3:7] == np.concatenate([b[c] for b in sliced])).all()


def test_binomial_bound_is_exact():
    for k, n, level in ((0, 50, 0.05), (3, 80, 0.01), (40, 200, 0.1)):
        p = quality_rules.upper_bound(k, n, level)
        assert math.isclose(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), level, rel_tol=1e-6)
    assert quality_rules.upper_bound(0, 0, 0.05) == 1 and quality_rules.upper_bound(5, 5, 0.05) == 1


def made_documents(n=1500, seed=2):
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "uno", "dos", "tres"] + [f"n{k}x" for k in range(300)]
    rows, labels = [], []
    for k in range(n):
        text = draw.choices(words, k=draw.randint(30, 60))
        bad = k % 4 == 0
        if bad:
            text = [w + draw.choice("#$%") for w in text]
        rows.append((k, " ".join(text) + ".", "en" if k % 3 else None))
        labels.append((k, int(not bad)))
    return rows, labels


def test_rules_reject_little_that_is_clean_and_the_model_learns(spark):
    rows, labels = made_documents()
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, told).collect()}
    clean = [kept[k] for k, q in labels if q]
    assert sum(clean) >= (1 - quality_rules.RISK) * len(clean)
    assert sum(not kept[k] for k, q in labels if not q) > 0.9 * 375
    scored = {r.doc_id: r for r in quality_model.predict(docs, told).collect()}
    assert all(scored[k].predicted == q for k, q in labels) and all(0 <= r.score <= 1 for r in scored.values())


def test_cutoffs_follow_the_exact_bound_and_small_strata_are_pooled(spark):
    """Chosen rungs are the last that a plain count of held-out rejections proves; strata with few labels share one test; no label, no cutoff."""
    draw = random.Random(6)
    rows, labels = [], []
    for k in range(2400):
        stratum = "big" if k < 1800 else f"s{k % 4}" if k < 2300 else "none"
        bad = k % 5 == 0
        text = [w + ("#" if bad or draw.random() < 0.004 else "") for w in draw.choices([f"n{j}x" for j in range(300)], k=40)]
        rows.append((k, " ".join(text), stratum))
        if stratum != "none":
            labels.append((k, int(not bad)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, told).collect()}
    assert {r.tested_as for r in got.values() if r.stratum == "big"} == {"=big"} and {r.tested_as for r in got.values() if r.stratum[0] == "s"} == {"*"}
    assert all(r.tested_as is None and r.rung is None and r.kept for r in got.values() if r.stratum == "none")
    for group in ("=big", "*"):
        held = [got[k] for k, q in labels if q and got[k].tested_as == group and zlib.crc32(str(k).encode()) % 4]
        rejected = sum(not r.kept for r in held)
        assert quality_rules.upper_bound(rejected, len(held), quality_rules.LEVEL / 2) <= quality_rules.RISK
        assert sum(not got[k].kept for k, q in labels if not q and got[k].tested_as == group) > 0.9 * sum(1 for k, q in labels if not q and got[k].tested_as == group)
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality_rules.judge(docs, empty).collect()) and quality_rules.judge(docs.limit(0), told).count() == 0
    odd = spark.createDataFrame([(None, "a " * 30, None), (1, None, "big"), (1, "b " * 5, "big")], "doc_id long, text string, lang string").withColumn("stratum", F.lit(1))
    assert sorted((r.doc_id or 0, r.kept) for r in quality_rules.judge(odd, told).collect()) == [(0, False), (1, False), (1, False)]


def test_quality_model_without_labels_texts_or_ids(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)] + [(None, "a"), (3, "again")], "doc_id long, text string")
    got = quality_model.predict(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(ODD) + 2 and {r.score for r in got} == {0.5} and not any(r.held_out for r in got if r.doc_id is None)
    one = quality_model.predict(docs, spark.createDataFrame([(k, 0) for k in range(9)], "doc_id long, quality int")).collect()
    assert all(r.predicted == 0 for r in one)
    assert quality_model.predict(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    named = quality_model.score(docs.withColumn("n_words", F.lit(1)), quality_model.fit(np.zeros((0, 16)), np.zeros(0)))
    assert named.columns == ["doc_id", "text", "n_words", "score"]


def test_pairs_of_features_are_learned():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 16))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    model = quality_model.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.85


def test_languages_by_held_out_accuracy(spark):
    draw = random.Random(1)
    sounds = {"aa": "ka lo mi ren tu", "bb": "schu öber ung tze ich", "cc": "ción esta ñor lla que"}
    rows = [(k, " ".join("".join(draw.choices(sounds[lang].split(), k=3)) for _ in range(40)), lang) for k in range(240) for lang in [draw.choice(list(sounds))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 456 !", "bb"), (None, rows[0][1], None), (1004, rows[0][1] * 400, None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    held = [(r, lang) for r in got for k, _, lang in rows[:240] if r.doc_id == k and r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == lang for r, lang in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1004].lang_pred == rows[0][2] and 0 <= by[1004].score <= 1
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_windows_hold_every_byte_once():
    data, offsets = np.arange(200, dtype=np.uint8), np.array([0, 0, 65, 66, 200])
    windows, owner = language_id.windows_of(data, offsets)
    assert windows[windows < 256].tolist() == list(range(200)) and owner.tolist() == [1, 1, 2, 3, 3, 3]


def test_gradient_of_the_network():
    """The gradient by backpropagation through time against a difference quotient."""
    model = language_id._start(["x", "y"], 4, 3)
    windows = np.random.default_rng(0).integers(0, 257, (9, 5)).astype(np.int16)
    unit = language_id.Direction(model.forward.look.astype(np.float64), model.forward.gate.astype(np.float64), model.forward.state.astype(np.float64))
    states, kept = unit.run(windows, True)
    aim = np.random.default_rng(1).standard_normal(states[1:].shape)
    found = language_id._through_time(unit, windows, states, kept, aim)
    for value, gradient in zip((unit.look, unit.gate, unit.state), found):
        for at in list(np.ndindex(value.shape))[:: max(value.size // 12, 1)]:
            value[at] += 1e-2
            up = float((unit.run(windows) * aim).sum())
            value[at] -= 2e-2
            down = float((unit.run(windows) * aim).sum())
            value[at] += 1e-2
            assert abs((up - down) / 2e-2 - gradient[at]) < 2e-2


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))] if 12 <= len(digits) <= 19 else [1]
                if sum(d - 9 * (d > 9) for d in doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return sorted(found)


PRIVATE = [
    None, "", "a@b.c_d@e.f x@y.z..q a@b", "1.2.3.4.5.6.7.8 256.1.1.1 001.255.0.9 1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "+49 (30) 1234-5678. +1 2 ++123456789",
    "𝒜𝒜 foo@bar.de 𝒜 +1.2.3.4.5.6.7.8.9.0 " + "9" * 30_000 + " x@y " + "a." * 20_000 + "@q.r", "a@b.c" * 2000, "o" * 100_000 + "@", "me@x.org\nme@x.org",
]


def test_base_spans_equal_plain_ones(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)) + [(None, "a@b.cd"), (3, PRIVATE[3])], "doc_id long, text string")
    got = pii.report(docs.withColumn("pii_base", F.lit(1))).collect()
    assert len(got) == len(PRIVATE) + 2
    for r in got:
        spans = plain_spans(PRIVATE[r.doc_id] if r.doc_id is not None else "a@b.cd")
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans == text and r.n_terms == 0
        assert [r[f"n_{k}"] for k in PLAIN] == [Counter(k for *_, k in spans)[k] for k in PLAIN]
    assert pii.report(docs.limit(0)).count() == 0


def test_terms_that_reveal_an_entity(spark):
    draw = random.Random(0)
    filler = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(400):
        text = " ".join(draw.choices(filler, k=30))
        if k < 12:  # the name stands only near this address, in different contexts; each other word stands anywhere
            text += f" {draw.choice(filler)} {draw.choice(filler)} Quentin, kq@mail.example {draw.choice(filler)}" + "\nthen Quentin left" * (k == 3)
        elif k < 30:  # copies of one passage are one context
            text += "\ncopied Wendell, ww@mail.example here"
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for k, text in rows:
        terms = [m.start() for m in re.finditer("Quentin", text)]
        assert [int(s.split(":")[1]) for s in got[k].spans.split(",") if s.startswith("term")] == terms
    clean = {r.doc_id: r.text for r in pii.sanitize(docs.withColumn("row", F.lit(1))).collect()}
    assert clean[3].endswith("left") and "Quentin" not in clean[3] and "@" not in clean[3] and "[WORD], [EMAIL]" in clean[3] and clean[399] == rows[399][1]


def test_terms_are_marked_in_rows_without_the_entity(spark):
    draw = random.Random(1)
    rows = []
    for k in range(400):
        text = " ".join(draw.choices([f"w{j}" for j in range(60)], k=30))
        if k < 12:
            text += f" {draw.choice(text.split())} {draw.choice(text.split())} Quentin, kq@mail.example {draw.choice(text.split())}"
        elif k in (100, 101, 102):  # the third also holds another entity
            text += " and (QUENTIN) left" + " ab@c.de" * (k == 102)
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for k, text in rows:
        terms = [m.start() for m in re.finditer("Quentin", text, re.I)]
        assert [int(s.split(":")[1]) for s in got[k].spans.split(",") if s.startswith("term")] == terms and got[k].n_terms == len(terms)
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert clean[100].endswith(" and ([WORD]) left") and clean[102].endswith(" left [EMAIL]") and clean[103] == rows[103][1]


def test_terms_on_other_lines_of_the_paragraph(spark):
    draw = random.Random(2)
    filler = [f"w{j}" for j in range(60)]
    card = " ".join(filler[:20])  # more than a window of 48 code points
    rows = []
    for k in range(400):
        text = " ".join(draw.choices(filler, k=30))
        if k < 8:  # a name above the address and one below; the paragraph before does not hold it
            text += f" Elsewhere\n \nregards\nQuentin\n{card}\nkq@mail.example\nOrlando"
        elif k < 16:  # copies of one document
            text = f"{card}\nWendell\nww@mail.example"
        rows.append((k, text + " regards"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for k, text in rows:
        terms = [m.start() for m in re.finditer("Quentin|Orlando", text)]
        assert [int(s.split(":")[1]) for s in got[k].spans.split(",") if s.startswith("term")] == terms


def test_sanitised_texts_keep_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "x 1.2.3.4 y a@b.cd", 1), (2, "+49 30 1234567x5555 5555 5555 4444", 2)], "doc_id long, text string, pii_base int")
    got = sorted(pii.sanitize(docs).collect(), key=str)
    assert {(r.doc_id, r.text, r.pii_base) for r in got} == {(1, None, 0), (1, "", 0), (None, "x [IP] y [EMAIL]", 1), (2, "[PHONE]x[CARD]", 2)}
    assert pii.sanitize(docs).columns == docs.columns


def test_edits_and_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    draw = random.Random(5)
    texts = [" ".join(draw.choices([f"wört{k}" for k in range(500)], k=draw.choice((0, 1, 5, 300)))) for _ in range(120)] + ["", None, "a", "aaaa" * 3000, "𝒜b"]
    texts += texts[:4]
    rows = list(enumerate(texts, -5))
    got = sorted(fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    prints = {}
    assert [r.doc_id for r in got] == [k for k, _ in rows]
    for at, r in enumerate(got):
        own, following = texts[at] or "", texts[(at + 1) % len(texts)] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and (own != edited or r.near_edited == 1)
    long = [r for r in got if r.n_chars > 1500]
    assert min(r.near_edited for r in long if r.doc_id < 110) >= 0 and sum(r.near_edited for r in long) / len(long) > 0.2


def test_equal_substrings_have_equal_phrases_at_any_offset():
    draw = random.Random(9)
    common = bytes(draw.choices(range(97, 123), k=4000))
    texts = [common, bytes(draw.choices(range(97, 123), k=777)) + common, b"x" + common + b"yyyy"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for names, owner in fingerprints.parse(data, offsets):
        sets = [set(names[owner == k].tolist()) for k in range(3)]
        assert len(sets[0] & sets[1]) >= len(sets[0]) - 30 and len(sets[0] & sets[2]) >= len(sets[0]) - 30


@pytest.mark.parametrize("rows", [[], [(1, "only one text of some words")], [(None, "x"), (None, None), (3, "y z")]])
def test_fingerprints_of_few_rows(spark, rows):
    got = fingerprints.compare_edits(spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(1))).collect()
    assert len(got) == len(rows) and all(r.near_next == 1 for r in got if len(rows) == 1)
