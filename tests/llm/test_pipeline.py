"""run() against the stages done plainly."""

import collections
import hashlib
import math
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import regex
from pyspark.sql import functions as F

from lexiflow.llm import quality, tokens

from .test_operators import EDGE, WORD, _brute_components


def _keys(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def _line_fails(line):
    share = lambda kind: sum(map(len, regex.findall(kind, line))) / len(line)
    phrases = lambda among: regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(among)})(?![\p{{L}}\p{{N}}])")
    low = line.lower()
    sure = phrases([x for x in quality.BOILERPLATE if x not in quality.COMMON]).search(low)
    rest = phrases(quality.COMMON).sub("", low).strip(" ")
    said = phrases(quality.BOILERPLATE).search(low) and (sure or 2 * len(rest) <= len(low.strip(" ")))
    other = regex.search(r"\p{Po}", regex.sub(rf"[\x00-\xFF -⁯{quality._NO_MARKS}]", "", line))
    return bool(
        share(r"[#*$%&|<>{}^~=\\]") > 0.08 or share("!") > 0.08 or len(regex.findall(r"[\x20\x09-\x0D][|»›•·][\x20\x09-\x0D]", line)) >= 3
        or (len(line) >= 12 and regex.search(r"\p{Lu}{2}", line) and share(r"\p{Lu}") > 0.6) or (len(line) <= 300 and said)
        or (len(line) >= 250 and not regex.search(quality._USUAL, line) and not other) or not regex.search(r"\p{L}", line)
    )


def _cleaned(text):
    """The text without failing lines; None where the document is rejected."""
    words = WORD.findall(text or "")
    grams = list(zip(words, words[1:], words[2:], strict=False))
    seen = collections.Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
        return None
    bad = [x for x in text.split("\n") if WORD.search(x) and _line_fails(x)]
    if sum(len(WORD.findall(x)) for x in bad) > 0.5 * len(words):
        return None
    return "\n".join(x for x in text.split("\n") if not (WORD.search(x) and _line_fails(x))) if bad else text


def _copies(rows):
    """{doc_id: copies} of (doc_id, text, source) by plain water filling and fitted draws."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total, of = collections.Counter(), collections.defaultdict(list)
    for i, _, source in rows:
        total[source] += size[i]
        of[source].append(i)
    ordered = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ordered)}
    left, full = set(ordered), 0
    while left:
        level = (1.5 * sum(total.values()) - full) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * total[s]}
        if not over:
            break
        full, left = full + sum(2 * total[s] for s in over), left - over
    out = {}
    for s in ordered:
        target = level * weight[s] if s in left else 2 * total[s]
        whole = math.floor(target / total[s]) if total[s] else 0
        want, upto, best = target - whole * total[s], 0, (target - whole * total[s], 0)
        step = {i: int(hashlib.md5(f"{i}/mix-1".encode()).hexdigest()[:8], 16) >> 20 for i in of[s]}
        for edge in sorted(set(step.values())):
            upto += sum(size[i] for i in of[s] if step[i] == edge)
            best = min(best, (abs(upto - want), edge + 1))
        out |= {i: whole + (step[i] < best[1]) for i in of[s]}
    return out


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, d).cache()
    rows = {r.doc_id: r for r in kept.collect()}
    given = docs.collect()
    want = {r.doc_id: _cleaned(r.text) for r in given}
    assert kept.columns == docs.columns and {i: r.text for i, r in rows.items()} == {i: t for i, t in want.items() if t is not None}
    assert 0 < len(rows) < len(given) and any(want[r.doc_id] not in (None, r.text) for r in given)

    held = collections.defaultdict(set)
    for i, r in rows.items():
        for line in (r.text or "").split("\n"):
            if len(_keys(line)) >= 20:
                held[_keys(line)].add(i)
    texts = {i: "\n".join(x for x in r.text.split("\n") if len(held.get(_keys(x), ())) < 3 or i == max(held[_keys(x)])) for i, r in rows.items()}
    lines = corpus_pipeline.line_dedup(spark, kept, d).cache()
    assert {r.doc_id: r.text for r in lines.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    roots = _brute_components(texts.items(), 5, 80)
    near = corpus_pipeline.near_dedup(spark, lines, d).cache()
    assert {r.doc_id for r in near.collect()} == {i for i in texts if roots[i] == i}

    drawn = _copies([(r.doc_id, r.text, r.source) for r in near.collect()])
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, near, d).collect())
    assert mixed == {i: n for i, n in drawn.items() if n}

    encode = tokens.WordTokenizer(Path(tokens.default_tokenizer()).read_text()).tokenizer.encode
    ids = {i: np.array([*encode(texts[i], add_special_tokens=False).ids, 1], "<u4") for i in mixed}
    packed, times, load = corpus_pipeline.run(spark, d).toPandas(), collections.Counter(), collections.Counter()
    for p in packed.itertuples():
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert len(part) == p.length and p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(part.tobytes())
        for at in range(p.start, p.start + p.length):
            times[p.doc_id, at] += 1
        load[p.sequence_id] += p.length
    assert times == {(i, at): n for i, n in mixed.items() for at in range(len(ids[i]))} and max(load.values()) <= 2048


def test_edge_rows(spark, tmp_path):
    """Nulls, empties, repeats, ties, an empty table, and columns with names that operators use, at every stage."""
    good = " ".join(f"Word{i} goes to town{i}, as it does." for i in range(20))
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in [*EDGE, (20, good, None, None), (20, good, None, None), (None, good, None, None)]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    seen = {}
    for name, data in (("edge", rows), ("more", rows), ("empty", [])):
        df = spark.createDataFrame(data, schema)
        if name == "more":
            df = df.withColumns({c: F.lit(i) for i, c in enumerate(("_q", "_drop", "_key", "_size", "_copies", "_gone", "rep", "key", "a"))})
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs, counts = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), []
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, f"{tmp_path}/{name}").cache()
            counts.append(sorted(map(str, docs.select("doc_id").collect())))
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == docs.columns and (out.count() > 0) == (name != "empty")
        seen[name] = counts
    assert seen["edge"] == seen["more"] and seen["empty"] == [[]] * 5
    # The good text is kept twice by its id, and without an id; a row of null id is no near copy of any.
    assert seen["edge"][0] == seen["edge"][2] == ["Row(doc_id=20)", "Row(doc_id=20)", "Row(doc_id=None)"]
