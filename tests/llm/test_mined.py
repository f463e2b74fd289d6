"""Personal data, hard negatives and resampling against brute force, other spellings and hot rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import hardneg, pii, queries, resample

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            out += [(kind, *m.span())] if good else []
    return out


def test_base_spans_against_patterns():
    draw = random.Random(3)
    texts = ["".join(draw.choice("a.@-+1 (2)3") for _ in range(draw.randint(0, 40))) for _ in range(20_000)]
    texts += ["".join(draw.choice("4539 148-803") for _ in range(60)) for _ in range(5_000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_base_spans_are_linear():
    for text in ("a." * 200_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "@" * 400_000, "a@" * 200_000):
        pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(1)
    ids, tags = pii._examples([("call 12 a@b.c now", [("email", 8, 13)]), ("at 1.2.3.4!", [("ip", 3, 10)])])
    tagger = pii.Tagger.new(rng, hidden=3, size=3)
    _, grad = tagger.loss(ids, tags)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        own, eps = tagger.p[name], np.float32(1e-2)
        old = own[at]
        around = []
        for step in (eps, -eps):
            own[at] = old + step
            around.append(tagger.loss(ids, tags)[0])
        own[at] = old
        assert (around[0] - around[1]) / (2 * eps) == pytest.approx(float(g[at]), rel=0.05, abs=2e-3), name


def test_best_tags_against_all_sequences():
    rng = np.random.default_rng(2)
    tagger = pii.Tagger.new(rng, hidden=3, size=3)
    tagger.p["step"] = rng.standard_normal(tagger.p["step"].shape).astype(np.float32)
    ids = rng.integers(1, 20, (6, 4))
    tags, _ = tagger.best_tags(ids)
    scores, step = tagger.emissions(ids)[0], tagger.p["step"] + pii._FORBIDDEN

    def total(row, seq):
        return sum(scores[row, i, t] for i, t in enumerate(seq)) + sum(step[a, b] for a, b in zip(seq, seq[1:])) - 1e4 * (seq[0] > 0 and seq[0] % 2 == 0)

    for row in range(len(ids)):
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda s: total(row, s))
        assert total(row, tuple(tags[row])) == pytest.approx(total(row, best), abs=1e-3)


def test_reconciled_sets_have_the_largest_weight():
    draw = random.Random(5)
    for _ in range(200):
        spans = [(0, s := draw.randint(0, 20), s + draw.randint(1, 8), draw.randint(1, 9) / 1, False, False) for _ in range(draw.randint(0, 7))]
        best = 0
        for k in range(len(spans) + 1):
            for some in itertools.combinations(spans, k):
                if all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(some, 2)):
                    best = max(best, sum(x[3] for x in some))
        found = pii.reconcile(spans)
        assert sum(w for *_, w in found) == best
        assert all(a[2] <= b[1] for a, b in itertools.pairwise(found))
    # A span that a window's edge cuts gives way to the same seen whole, or is joined to its other piece.
    assert pii.reconcile([(1, 40, 48, 5.0, False, True), (1, 40, 60, 9.0, False, False)]) == [(1, 40, 60, 9.0)]
    assert pii.reconcile([(1, 40, 96, 5.0, False, True), (1, 48, 120, 7.0, True, False)]) == [(1, 40, 120, 7.0)]


@pytest.fixture(scope="module")
def tagger(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return pii.fit(pii.label(pii.sample(docs.filter("doc_id % 3 <> 1"))))


def test_other_spellings_are_found_and_clean_texts_left(spark, tagger):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = [r.text for r in docs.filter("doc_id % 3 = 1 AND text IS NOT NULL").orderBy("doc_id").collect()]
    draw, found, n = np.random.default_rng(9), 0, 0
    for text in texts:
        for kind, start, end in pii.base_spans(text):
            other = pii._spelled(kind, text[start:end], draw)
            if kind == "card":  # with a digit that passes the check
                at = max(i for i, c in enumerate(other) if c.isdigit())
                other = next(x for d in "0123456789" if pii.luhn(re.sub("[^0-9]", "", x := other[:at] + d + other[at + 1 :])))
            before = text[max(0, start - 60) : start]
            n += 1
            spans = pii.find(tagger, [before + other + text[end : end + 60]])[0]
            found += any((k, s, e) == (kind, len(before), len(before) + len(other)) for k, s, e, _ in spans)
    assert n > 100 and found >= 0.8 * n
    added = [s for spans in pii.find(tagger, texts) for s in spans if not s[3]]
    assert len(added) <= 0.01 * n
    alone = pii.tagged(tagger, texts)
    seen = sum(s in {pii._counted(t, k, a, b) for k, a, b, _ in f} for t, f in zip(texts, alone, strict=True) for s in pii.base_spans(t))
    assert seen >= 0.9 * n


def test_windows_cover_long_texts(tagger):
    """Spans at all places of a grid of windows, and beyond the reach of one window."""
    draw = random.Random(4)
    words = ["word"] * 4000
    text, at = "", []
    for i, w in enumerate(words):
        if i % 40 == 7:
            address = "jan.0%d@mail%d.example.com" % (draw.randint(0, 9), draw.randint(0, 9))
            at.append((len(text), len(text) + len(address)))
            text += address + " "
        text += w + " " * draw.randint(1, 3)
    spans = {pii._counted(text, *s[:3]) for s in pii.tagged(tagger, [text])[0]}
    assert sum(("email", *p) in spans for p in at) >= 0.97 * len(at)
    assert pii.find(None, [text]) == [[("email", *p, True) for p in at]]


def test_query_against_plain_spans(spark, tmp_path):
    rows = [(1, "mail a.b@c.de, ip 1.2.3.4 card 4539148803436467 tel +1 (407) 555-7710 é"), (2, None), (3, ""), (None, "x 4539-1488-0343-6467"), (3, "999.1.1.1")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.01"):
        got = queries.op11_pii(spark, sf).collect()
        docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
        want = []
        for doc in docs:
            spans = plain_spans(doc.text or "")
            n = collections.Counter(k for k, *_ in spans)
            listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
            want.append((doc.doc_id, *(n[k] for k in pii.KINDS), hashlib.sha256(listed.encode()).hexdigest()))
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
        order = {k: i for i, k in enumerate(pii.KINDS)}
        for r in got:
            spans = [(order[k], int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
            assert spans == sorted(spans)


def test_redact_and_reruns(spark, tagger):
    rows = [(1, "mail a.b@c.de, tel +1 (407) 555-7710.", 5), (2, None, 6), (3, "nothing", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans int")
    assert [tuple(r) for r in pii.redact(df, tagger).orderBy("doc_id").collect()] == [(1, "mail <email>, tel <phone>.", 5), (2, None, 6), (3, "nothing", 7)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (pii.fit(pii.label(pii.sample(docs.repartition(n)))) for n in (2, 7))
    assert all(np.allclose(one.p[k], two.p[k]) for k in one.p)


def plain_negatives(rows, every=100, n_positives=5, n_negatives=10):
    known = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, v in known:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in known]
        positives = sorted((s, j) for s, j, m in scored if m == lab and j != i)[:n_positives]
        for s, j in positives:
            fit = sorted((t, k) for t, k, m in scored if m != lab and 30 * -s <= 100 * -t <= 90 * -s)[:n_negatives]
            out += ((i, j, r, k, -s, -t) for r, (t, k) in enumerate(fit, 1))
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    return sorted(map(tuple, hardneg.mine(df, **more).collect()))


def test_hard_negatives_of_random_rows(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(i, [round(draw.gauss(0, 1), 3) for _ in range(draw.choice((0, 2, 3, 3, 3)))], draw.randint(0, 3)) for i in range(400)]
    assert mined(spark, rows) == plain_negatives(rows)
    monkeypatch.setattr(hardneg, "BLOCK", 2)
    monkeypatch.setattr(hardneg, "GATHER", 3)
    assert mined(spark, rows, n_negatives=2) == plain_negatives(rows, n_negatives=2)


def test_many_rows_of_one_score(spark, monkeypatch):
    """Ties go on by ids: few rows are gathered, however many share a vector."""
    monkeypatch.setattr(hardneg, "GATHER", 12)
    rows = [(i, [1.0, 0.5, 0.25], 1 + i % 2) for i in range(1000, 3000)] + [(0, [1.0, 1.0, 1.0], 1), (5, [2.0, 1.0, 1.0], 1), (2**40, [1.0, 0.5, 0.25], 2), (-3, [1.0, 0.5, 0.25], 2)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and len({r[1] for r in got if r[0] == 0}) == 1
    block = hardneg._Block([{"vec_id": 0, "label": 1, "vec": [256, 256, 256]}], 3, True)
    windows = hardneg._Windows(np.array([0]), np.array([0]), np.array([1 << 20]), 10, (-3, 2**40))
    known = hardneg.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert hardneg._select(known, block, windows, same=False).count() == 10
    assert windows.above[0] + (windows.last[0] - windows.first[0] + 1) < 2000 and windows.by_id[0]


def test_scores_beyond_doubles_are_exact_or_refused(spark):
    big = float(2**21 - 1)
    rows = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big * 0.75, 1.0], 2), (3, [big * 0.75, 2.0], 2)]
    assert mined(spark, rows) == plain_negatives(rows)
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1)])


def features(text):
    words = FEATURE.findall((text or "").translate(LOWER))
    return words + [f"{a} {b}" for a, b in itertools.pairwise(words)], len(words)


def plain_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [features(text) for _, text in docs]
    s, t = (collections.Counter(bucket(f) for fs in some for f in fs) for some in ([f for f, _ in own], [features(x)[0] for x in target]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (doc, _), (found, n) in zip(docs, own, strict=True):
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for rank, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("chunk", [None, 300])
def test_resampling_against_plain_counts(spark, monkeypatch, chunk):
    draw = random.Random(8)
    vocabulary = ["Abc", "é9", "zz", "the", "日本", "x" * 80, "x" * 70 + "y", "q" * 64, "Straße", "İ"]
    docs = [(i, draw.choice([" ", "-", "  _ ", "\n"]).join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))) for i in range(150)]
    docs += [(None, None), (7, ""), (8, "-- !"), *[(9, "the abc " * 30)] * 9, (None, "the abc " * 30), (9, "abc the " * 30)]
    if chunk:
        monkeypatch.setattr(resample, "_CHUNK_BYTES", chunk)
        monkeypatch.setattr(resample, "_PART_BYTES", chunk)
    target = ["the abc zz", None, "straße 日本 日本", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(4)
    got = resample.resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target)
    drawn = resample.draw(df, spark.createDataFrame([(x,) for x in target], "text string"))
    assert drawn.columns == df.columns and drawn.count() >= sum(r[4] is not None for r in plain_resample(docs, target))


def test_dictionary_counts_strings(spark):
    rows = [("The THE the cat", ), ("the-cat", ), (None, )]
    got = resample.dictionary(spark.createDataFrame(rows, "text string")).collect()
    assert {r.feature: r.n for r in got} == {"the": 4, "cat": 2, "the the": 2, "the cat": 2}
    assert {r.bucket: r.n for r in resample.bucket_counts(resample.dictionary(spark.createDataFrame(rows, "text string"))).collect()} == collections.Counter(
        {zlib.crc32(f.encode()) % 10_000: n for f, n in (("the", 4), ("cat", 2), ("the the", 2), ("the cat", 2))}
    )
