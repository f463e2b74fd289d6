"""Toxicity (operator 4): maximum-scoring segments over token log-odds, calibrated by extreme values.

Fit, from a bounded sample of labelled rows: document counts of hashed grams (5 bytes of a word with its
boundaries, and its first 8 bytes) by label give log-odds with a Dirichlet prior in proportion to the background.  A token scores
the largest log-odds among its grams that are significant, else ``-gap``.  A linear scan (maximal
segments after Ruzzo and Tompa) finds every passage.  A passage of score S among n tokens has the
expected count E = K n exp(-lambda S) in clean text; lambda and K are the slope and rate of the tail of
passage scores in the sample's clean rows, by maximum likelihood.  A document's evidence is the sum of -ln E over passages
with E < 1, and a one-variable logistic curve with a ridge, which allows for wrong labels, makes it a probability.

The sample's bound is ``max_rows``; grams go to 2**20 buckets, so the model has a fixed size and is the
only thing that is sent to every task.  Every text is scored whole, in pieces of the Arrow buffer.

Defined results: null and empty texts have no tokens and the score of no evidence; labels other than 0 and
1 are not learnt from; several labels of one document, or of exact copies, count as the largest, and copies are learnt
once; the fit sorts what it sums, so reruns agree in any partitioning;
without both classes in the sample every score is the share of label 1 in it (0 if it is empty); an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import common

#: Labelled rows that are learnt from, at most (in expectation).
MAX_ROWS = 20_000
BITS, GRAM, BEGINNING, GAP, PRIOR, MAX_SCORE = 20, 5, 9, 1.0, 100.0, 8.0
#: (least z, least log-odds): rare and telling, or frequent and telling enough; chosen by threefold cross-validation
#: over learning rows alone.
SIGNIFICANT = ((3.5, 3.0), (4.5, 1.5))


def is_held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


class _Text:
    """Words and grams of some rows, a space before each row and after the last."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.rows = len(offsets) - 1
        data = np.insert(common._LOWER[data], offsets, 32)
        base = offsets + np.arange(len(offsets))
        space = common._IS_SPACE[data]
        start = ~space[1:] & space[:-1]
        self.word = np.cumsum(start) - 1  # of byte i + 1, if that is no space
        self.starts = np.flatnonzero(start) + 1
        self.first = np.searchsorted(self.starts, base)
        n = len(data) - GRAM + 1
        if n <= 0:
            self.at, self.bucket = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        inner = np.ones(n, bool)
        for i in range(1, GRAM - 1):
            inner &= ~space[i : i + n]
        self.at = np.flatnonzero(inner)
        data = np.where(space, np.uint8(32), data).astype(np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(GRAM):
            h = (h << np.uint64(8)) | data[i : i + n]
        # Beginnings of words: the space and eight bytes (the space is shifted out).
        n = max(len(data) - BEGINNING + 1, 0)
        head = space[:n].copy()
        for i in range(1, BEGINNING - 1):
            head &= ~space[i : i + n]
        heads = np.flatnonzero(head)
        long_ = np.zeros(len(heads), np.uint64)
        for i in range(BEGINNING):
            long_ = (long_ << np.uint64(8)) | data[heads + i]
        keys = np.concatenate([h[self.at] + np.uint64(1), long_ + np.uint64(1 << 63)])
        bucket = (common.mix(keys) >> np.uint64(64 - BITS)).astype(np.int64)
        order = np.argsort(np.concatenate([self.at, heads]), kind="stable")
        self.at, self.bucket = np.concatenate([self.at, heads])[order], bucket[order]

    def gram_words(self) -> np.ndarray:
        return self.word[self.at]

    def gram_rows(self) -> np.ndarray:
        return np.searchsorted(self.first, self.gram_words(), side="right") - 1


def _texts(column: pa.Array) -> Iterator[tuple[int, _Text]]:
    raw, offsets = common.utf8(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = min(max(int(np.searchsorted(offsets, offsets[row] + (1 << 20), side="right")) - 1, row + 1), n)
        yield row, _Text(raw[int(offsets[row]) : int(offsets[last])], offsets[row : last + 1] - offsets[row])
        row = last


def log_odds(toxic: np.ndarray, clean: np.ndarray, rows1: int, rows0: int, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z) of each gram from the rows that hold it.

    The prior is Dirichlet: ``prior`` pseudo-counts spread as the background, and a half for each gram.
    z is the signed root of the likelihood ratio of the counts, which stays sound where one of them is 0.
    """
    total = toxic + clean
    a = prior * total / max(total.sum(), 1.0) + 0.5
    y1, y0 = toxic + a, clean + a
    delta = np.log(y1 / (rows1 + 1)) - np.log(y0 / (rows0 + 1))
    share = rows1 / (rows1 + rows0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.nan_to_num(toxic * np.log(toxic / (total * share))) + np.nan_to_num(clean * np.log(clean / (total * (1 - share))))
    return delta, np.sign(delta) * np.sqrt(2 * np.maximum(g, 0))


def segments(places: np.ndarray, scores: np.ndarray, gap: float = GAP) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment (first token, past last, score) where other tokens score -gap.

    ``places``: tokens of positive score, rising.  Linear: each candidate is pushed and merged away once.
    """
    stack: list[list] = []  # [first, end, left sum, right sum, previous candidate with smaller left sum]
    total, at = 0.0, 0
    for p, s in zip(places.tolist(), scores.tolist(), strict=True):
        total -= gap * (p - at)
        cand = [p, p + 1, total, total + s]
        total, at = total + s, p + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= cand[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= cand[3]:
                stack.append([*cand, j])
                break
            cand = [stack[j][0], cand[1], stack[j][2], cand[3]]
            del stack[j:]
    return [(a, b, r - left) for a, b, left, r, _ in stack]


@dataclass
class Model:
    weights: np.ndarray  # per bucket, 0 where not significant
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)  # intercept, slope
    constant: float | None = None

    def passages(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Per row: tokens, and the segments of token numbers."""
        for _, text in _texts(column):
            w = self.weights[text.bucket]
            hit = np.flatnonzero(w > 0)
            words = text.gram_words()[hit]
            edge = np.flatnonzero(np.diff(words, prepend=-1))
            best = np.maximum.reduceat(w[hit], edge) if len(hit) else np.zeros(0)
            words = words[edge]
            bound = np.searchsorted(words, text.first)
            for i in range(text.rows):
                lo, hi = bound[i], bound[i + 1]
                yield int(text.first[i + 1] - text.first[i]), segments(words[lo:hi] - text.first[i], best[lo:hi]) if hi > lo else []

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        base = math.log(self.k * max(n, 1))
        return sum(max(0.0, self.lam * s - base) for _, _, s in found)

    def probability(self, x: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] + self.curve[1] * math.log1p(x)))))


def _tail(scores: np.ndarray, tokens: int) -> tuple[float, float]:
    """(lambda, K) of the exponential tail of passage scores, by maximum likelihood: passages of S or more per token are K exp(-lambda S)."""
    least = float(scores.min())
    lam = float(np.clip(len(scores) / max(float((scores - least).sum()), 1e-9), 0.2, 3.0))
    return lam, len(scores) / tokens * math.exp(lam * least)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta * [0.01, 1]
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.diag([0.01, 1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The logistic curve where some labels are wrong.

    The share of label 1 among rows without evidence is taken for the share of wrong ones; each row of label 1
    counts by the probability that its label is right (expectation and maximisation in turn).
    """
    beta, right = _logistic(x, y), y.copy()
    if not (x == 0).any():
        return beta
    wrong = float(y[x == 0].mean())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * x, -30, 30)))
        now = np.where(y == 1, p / np.maximum(p + (1 - p) * wrong, 1e-12), 0.0)
        if np.abs(now - right).max() < 1e-9:
            break
        right = now
        beta = _logistic(x, right)
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learns from at most about ``max_rows`` of ``labels``' rows that are not held out."""
    label = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    label = label.filter(~is_held_out(F.col("_id")))
    n = label.count()
    if n > max_rows:
        label = label.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.lit(int(1e6 * max_rows / n)))
    label = common.cut(label, "toxic-labels")
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text"))
    sample = rows.join(F.broadcast(label), "_id").groupBy("_text").agg(F.max("_y").alias("_y")).select("_y", "_text")
    sample = common.cut(sample, "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            rows += np.bincount(y, minlength=2)
            for row, text in _texts(batch.column(1)):
                pairs = np.unique(text.gram_rows() << BITS | text.bucket)
                own = y[row + (pairs >> BITS)]
                for c in (0, 1):
                    seen[c] += np.bincount(pairs[own == c] & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(seen.sum(0))
        at_all = np.concatenate([at, [-1]])  # -1: rows
        yield pa.RecordBatch.from_arrays([pa.array(at_all), pa.array(np.append(seen[0][at], rows[0])), pa.array(np.append(seen[1][at], rows[1]))], ["bucket", "clean", "toxic"])

    counted = sample.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    rows = counted[counted.bucket < 0]
    n0, n1 = int(rows.clean.sum()), int(rows.toxic.sum())
    weights = np.zeros(1 << BITS, np.float32)
    if not n0 or not n1:
        return Model(weights, constant=n1 / (n0 + n1) if n0 + n1 else 0.0)
    counted = counted[counted.bucket >= 0]
    delta, z = log_odds(counted.toxic.to_numpy(float), counted.clean.to_numpy(float), n1, n0)
    good = np.logical_or.reduce([(z >= a) & (delta >= b) for a, b in SIGNIFICANT])
    weights[counted.bucket.to_numpy()[good]] = np.minimum(delta[good], MAX_SCORE)
    model = Model(weights)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(model.passages(batch.column(1)))
            lists = pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), lists], ["y", "n", "s"])

    scanned = sample.mapInArrow(scan, "y int, n long, s array<double>").toPandas()  # as many rows as the sample
    clean = scanned[scanned.y == 0]
    tokens = max(int(clean.n.sum()), 1)
    in_clean = np.concatenate([*clean.s, np.zeros(0)])
    in_toxic = np.concatenate([*scanned[scanned.y == 1].s, np.zeros(0)])
    typical = float(np.median(in_toxic)) if len(in_toxic) else 1.0
    scores = np.sort(np.append(in_clean, min(typical, MAX_SCORE)))  # one more, so that the rate is never 0
    model.lam, model.k = _tail(scores, tokens)
    x = np.log1p([model.evidence(n, [(0, 0, v) for v in s]) for n, s in zip(scanned.n, scanned.s, strict=True)])
    y = scanned.y.to_numpy(float)
    order = np.lexsort((y, x))
    model.curve = _curve(np.asarray(x, float)[order], y[order])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and passages (array of first token, past last token, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, passages = [], []
            for n, found in model.passages(batch.column(1)):
                scores.append(model.probability(model.evidence(n, found)))
                passages.append([{"first": a, "end": b, "score": s} for a, b, s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, passages array<struct<first: int, end: int, score: double>>")
