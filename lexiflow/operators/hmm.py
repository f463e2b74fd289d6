"""Parts of speech by a hidden Markov model: counts by expectation-maximisation over the corpus, Viterbi for each sentence.

Tags are states.  What a state emits is a word of the frequency list's first ``WORDS`` or of the closed lists, or else the class of a
word's ending and case, so the model has a bounded size.  The rule tagger's lists are the seed: they say where expectation begins,
and stay as a prior.  Sentences are numbered once; an iteration is one pass over the numbers: each task sums expected counts (forward and backward), Spark adds
them, and a model goes out again.  Sums are rounded, so reruns agree in any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.operators import tagging

TAGS = ("Noun", "Verb", "Adjective", *tagging.FUNCTION_TAGS)
#: Words of the frequency list that count by themselves; passes over the corpus; how much the seed counts, in words.
WORDS, ROUNDS, PRIOR = 5000, 3, 20.0
_ENDINGS = tuple((end, tag) for tag, ends in tagging.ENDINGS for end in ends.split())
_CELLS = 1 << 17  # words gone through side by side
_MET = 50_000  # words whose numbers a worker keeps
WORD_PATTERN = "[A-Za-z][A-Za-z'-]*"


def classes() -> list[str]:
    """Names of what is no listed word: capital or not, by the first ending that fits."""
    return [f"{case}{end}" for case in ("", "^") for end in ("*", *(f"-{e}" for e, _ in _ENDINGS))]


class Symbols:
    """Numbers of what states emit."""

    def __init__(self, words: list[str]):
        self.names = [*classes(), *sorted(set(words) | set(tagging.WORDS))]
        self.of = {name: i for i, name in enumerate(self.names)}
        self.met: dict[str, int] = {}

    def number(self, word: str) -> int:
        if (known := self.met.get(word)) is not None:
            return known
        if len(self.met) >= _MET:
            self.met.clear()
        low = word.lower()
        if low in self.of:
            out = self.of[low]
        else:
            end = next((f"-{e}" for e, _ in _ENDINGS if low.endswith(e)), "*")
            out = self.of[("^" if word[0].isupper() else "") + end]
        self.met[word] = out
        return out


@dataclass
class Model:
    start: np.ndarray  # by tag
    step: np.ndarray  # from tag, to tag
    emit: np.ndarray  # tag, symbol

    @classmethod
    def counted(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        share = lambda x: np.round(x / x.sum(-1, keepdims=True), 12)
        return cls(share(start), share(step), share(emit))

    def forward(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By tag and word of the block: emissions, scaled forward sums, and the words' scales; the log-likelihood is the sum of the scales' logs."""
        met = np.take(self.emit, block.ids, axis=1)
        out, scale = np.empty_like(met), np.empty(len(block.ids))
        for t, here in enumerate(block.steps):
            a = met[:, here] * (self.step.T @ out[:, block.before(t)] if t else self.start[:, None])
            scale[here] = np.maximum(a.sum(0), 1e-300)
            np.divide(a, scale[here], out=out[:, here])
        return met, out, scale

    def expected(self, ids: np.ndarray | Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first tags, steps and emissions, and the log-likelihood."""
        block = ids if isinstance(ids, Block) else Block.of(ids)
        met, alpha, scale = self.forward(block)
        step, shares, ahead = np.zeros_like(self.step), np.empty_like(alpha), np.empty((len(self.start), 0))
        for t in range(len(block.steps) - 1, -1, -1):
            here = block.steps[t]
            # Sentences that end here come last.
            beta = np.ones((len(self.start), here.stop - here.start))
            beta[:, : ahead.shape[1]] = self.step @ ahead
            both = alpha[:, here] * beta
            both /= np.maximum(both.sum(0), 1e-300)
            shares[:, here] = both
            if t:
                ahead = met[:, here] * beta / scale[here]
                step += alpha[:, block.before(t)] @ ahead.T
        emit = np.stack([np.bincount(block.ids, own, self.emit.shape[1]) for own in shares])
        return shares[:, block.steps[0]].sum(1), self.step * step, emit, float(np.log(scale).sum())

    def viterbi(self, ids: np.ndarray | Block) -> np.ndarray:
        """The likeliest tags of sentences, word after word; of equal ones the first in ``TAGS``.  Of a table of sentences of one length, a table."""
        block = ids if isinstance(ids, Block) else Block.of(ids)
        log = lambda x: np.log(np.maximum(x, 1e-300))
        step, met = log(self.step), np.take(log(self.emit), block.ids, axis=1)
        best, back = log(self.start)[:, None] + met[:, block.steps[0]], np.zeros(met.shape, np.int8)
        ends = np.zeros(len(block.ids), np.int8)
        for t, here in enumerate(block.steps):
            if t:
                last, n = best, here.stop - here.start
                ends[block.steps[t - 1]][n:] = last[:, n:].argmax(0)
                best = last[0, :n] + step[0][:, None]
                for k in range(1, len(step)):
                    over = last[k, :n] + step[k][:, None]
                    np.copyto(back[:, here], k, where=over > best)
                    np.maximum(best, over, out=best)
                best += met[:, here]
        ends[block.steps[-1]] = best.argmax(0)
        for t in range(len(block.steps) - 1, 0, -1):
            here = block.steps[t]
            ends[block.before(t)] = back[ends[here], np.arange(here.start, here.stop)]
        out = ends[block.place].astype(np.int64)
        return out if isinstance(ids, Block) else out.reshape(ids.shape)


class Block:
    """Sentences of any lengths side by side: first words of all, the longest sentence first, then second words, and so on.

    ``ids``: numbers of the words in that order; ``place``: where in it each word is, sentence after sentence; ``steps``: the first, second... words.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        long = len(sizes) - np.cumsum(np.bincount(sizes))[:-1]  # sentences that have such a word
        first = np.cumsum(long) - long
        self.steps = [slice(a, a + n) for a, n in zip(first.tolist(), long.tolist(), strict=True)]
        at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = first[at] + np.repeat(rank, sizes)
        self.ids = np.empty(len(ids), np.int64)
        self.ids[self.place] = ids

    @classmethod
    def of(cls, table: np.ndarray) -> Block:
        return cls(table.ravel(), np.full(len(table), table.shape[1]))

    def before(self, t: int) -> slice:
        """The words before the ``t``-th ones."""
        here, last = self.steps[t], self.steps[t - 1]
        return slice(last.start, last.start + here.stop - here.start)


def seed(symbols: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts that the lists stand for: a closed word has its tag, an ending its own, other words are nouns rather than the rest."""
    n = len(TAGS)
    emit = np.full((n, len(symbols.names)), 1e-3)
    for name, i in symbols.of.items():
        tag = tagging.WORDS.get(name) or next((t for e, t in _ENDINGS if name.endswith(e)), None)
        if tag:
            emit[TAGS.index(tag), i] += 1
        else:
            emit[:3, i] += (0.5, 0.3, 0.2)
    step = np.ones((n, n))
    for before, after in FOLLOWED:
        step[TAGS.index(before), TAGS.index(after)] += n
    return np.ones(n) * PRIOR / n, step * PRIOR / n, PRIOR * emit


#: Tags that the seed takes to follow each other; expectation starts from something, or nouns and verbs never part.
FOLLOWED = (
    ("Determiner", "Noun"), ("Determiner", "Adjective"), ("Adjective", "Noun"), ("Modal", "Verb"), ("Auxiliary", "Verb"), ("Pronoun", "Verb"),
    ("Preposition", "Determiner"), ("Preposition", "Noun"), ("Noun", "Verb"), ("Verb", "Determiner"), ("Copula", "Adjective"),
)


def _numbered(words: pa.ListArray, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of sentences, one after the other, and the sentences' sizes.  A batch's different words are looked at once each."""
    coded = words.flatten().dictionary_encode()
    known = np.array([symbols.number(w) for w in coded.dictionary.to_pylist()], np.int32)
    return known[coded.indices.to_numpy(zero_copy_only=False)], words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _cut(sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(sentences, words) of runs of sentences with so many words that go through side by side; a longer sentence is a run of its own."""
    past = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(past, past[at] + _CELLS, "right")) - 1)
        yield slice(at, end), slice(int(past[at]), int(past[end]))
        at = end


def tokens(sentences: DataFrame) -> DataFrame:
    """``sentences`` (doc_id, para_idx, sent_idx, sentence) with their words."""
    return sentences.select("doc_id", "para_idx", "sent_idx", F.regexp_extract_all("sentence", F.lit(WORD_PATTERN), F.lit(0)).alias("words"))


def fit(sentences: DataFrame, words: list[str], rounds: int = ROUNDS) -> tuple[Symbols, Model, list[float]]:
    """A model of ``sentences``, and the log-likelihood before each round."""
    symbols = Symbols(words)
    base = seed(symbols)
    model, n, history = Model.counted(*base), len(TAGS), []
    size = len(symbols.names)
    # Sentences are cut to words and numbered once; the rounds read numbers alone.
    blocks = _blocks(sentences, symbols).persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(rounds):
        state = blocks.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            own = state.value
            total, likely = [np.zeros(n), np.zeros((n, n)), np.zeros((n, size))], 0.0
            for batch in batches:
                for ids, sizes in zip(*batch.columns, strict=True):
                    *found, log = own.expected(Block(*(np.frombuffer(x.as_py(), np.int32) for x in (ids, sizes))))
                    for sums, counts in zip(total, found, strict=True):
                        sums += counts
                    likely += log
            total = np.concatenate([sums.ravel() for sums in total])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], likely))], ["at", "n"])

        summed = blocks.mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n"))
        counts = np.zeros(n + n * n + n * size)
        for at, k in summed.collect():  # a row for each number of the model
            if at < 0:
                history.append(k)
            else:
                counts[at] = round(k, 6)
        state.destroy()
        start, step, emit = np.split(counts, [n, n + n * n])
        model = Model.counted(base[0] + start, base[1] + step.reshape(n, n), base[2] + emit.reshape(n, size))
    blocks.unpersist()
    return symbols, model, history


def _blocks(sentences: DataFrame, symbols: Symbols) -> DataFrame:
    """(ids, sizes): numbers of sentences' words and sizes of sentences, as bytes of 32-bit integers; a row for some ``_CELLS`` words."""
    state = sentences.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting = state.value, []

        def row() -> pa.RecordBatch:
            columns = [pa.array([np.concatenate(x).astype(np.int32).tobytes()], pa.binary()) for x in zip(*waiting, strict=True)]
            waiting.clear()
            return pa.RecordBatch.from_arrays(columns, ["ids", "sizes"])

        for batch in batches:
            ids, sizes = _numbered(batch.column(0), known)
            sizes = sizes[sizes > 0]
            for some, words in _cut(sizes):
                if waiting and sum(len(x) for x, _ in waiting) + words.stop - words.start > _CELLS:
                    yield row()
                waiting.append((ids[words], sizes[some]))
        if waiting:
            yield row()

    return tokens(sentences).select("words").mapInArrow(run, "ids binary, sizes binary")


def tag(sentences: DataFrame, symbols: Symbols, model: Model) -> DataFrame:
    """(doc_id, para_idx, sent_idx, term_idx, text, tag) of every word."""
    state = sentences.sparkSession.sparkContext.broadcast((symbols, model))
    names = ["doc_id", "para_idx", "sent_idx", "words", "tags"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = state.value
        for batch in batches:
            ids, sizes = _numbered(batch.column(3), known)
            found = [own.viterbi(Block(ids[words], sizes[some])) for some, words in _cut(sizes) if words.start < words.stop]
            tags = pa.array(TAGS).take(pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            tags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tags)
            yield pa.RecordBatch.from_arrays([*batch.columns, tags], names)

    rows = tokens(sentences).mapInArrow(run, "doc_id long, para_idx long, sent_idx long, words array<string>, tags array<string>")
    word = F.posexplode(F.arrays_zip("words", "tags")).alias("term_idx", "x")
    out = rows.select("doc_id", "para_idx", "sent_idx", word)
    return out.select("doc_id", "para_idx", "sent_idx", F.col("term_idx").cast("long").alias("term_idx"), F.col("x.words").alias("text"), F.col("x.tags").alias("tag"))


def pos_tags(sentences: DataFrame, freq: DataFrame, rounds: int = ROUNDS, **enabled) -> DataFrame:
    """(doc_id, para_idx, sent_idx, term_idx, text, pos) of highlighted words, as the rule tagger's; fitted on the sentences themselves."""
    words = [r["word"] for r in freq.filter(F.col("rank") < WORDS).select("word").collect()]
    symbols, model, _ = fit(sentences, words, rounds)
    rows = tag(sentences, symbols, model)
    pos = tagging.pick_tag(F.array("tag"), F.col("text"), **enabled)
    return rows.withColumn("pos", pos).filter("pos IS NOT NULL").drop("tag")
