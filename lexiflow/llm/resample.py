"""Target-distribution importance resampling (operator 13) with a dictionary of distinct features.

Features are words and pairs of neighbouring words, as strings.

1. Each task counts the features of its texts, some MB at a time: words become places in a dictionary of these texts, pairs are
   pairs of places, so only different features are made into strings, once each, and leave the task with their counts.
2. Parts of the strings' space, so many that each stays small, sum counts by string: the corpus's dictionary.  Each string is
   hashed there once, and buckets sum its counts.
3. A bucket's gain says how much likelier the target makes it than the corpus.  Gains (``buckets`` numbers, whatever the
   corpus's size) are broadcast and join the different features of a task's texts by their bucket; a document's weight is the
   mean over its own features.  A shuffle of every (document, feature) would be some times as large as the corpus.
4. A seeded Gumbel draw is added, and the largest scores are drawn.  Ranks need no sort of all rows in one task: scores are
   integers, so the rows of larger scores are sums over score levels, and rows are ordered within one score alone.

Defined results: a null or empty text has no words and weight 0; rows that repeat are drawn as rows of their own with equal
scores and ranks that follow each other; ties go to smaller doc_ids, a null one last (its draw is that of an empty id), then to
fewer features and smaller weights; without target texts, or without documents, all gains follow from zero counts; an empty
table gives no rows; texts of any length are read whole; extra columns are not read (``draw`` keeps them).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm import common
from lexiflow.llm.common import Tables

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, "7:"
COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]
_CHUNK_BYTES, _PART_BYTES, _LONG = 1 << 23, 1 << 23, 64
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGNS = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """The change of a state of crc32 by each byte, from its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def crc_states(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> np.ndarray:
    """States of crc32 after the bytes of each span, all spans a byte at a time; of spans over ``_LONG`` bytes one by one."""
    order = np.argsort(-sizes, kind="stable")
    start, size, state = starts[order], sizes[order], states[order].copy()
    many = int(np.searchsorted(-size, -_LONG, side="left"))  # spans over _LONG
    left = len(size)
    for at in range(_LONG):
        left = int(np.searchsorted(-size, -at, side="left"))
        if left <= many:
            break
        state[many:left] = _step(state[many:left], data[start[many:left] + at])
    for i in range(many):
        done = zlib.crc32(data[start[i] : start[i] + size[i]].data, int(state[i] ^ _SIGNS))
        state[i] = np.uint32(done) ^ _SIGNS
    out = np.empty_like(state)
    out[order] = state
    return out


class _Features:
    """The features of some texts: different words, words as places among them, and different pairs of places."""

    def __init__(self, column: pa.Array):
        raw, offsets = common.utf8(column)
        raw, offsets = raw[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
        data = common._LOWER[raw]
        inside = _WORD_BYTE[raw]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(start)
        sizes = np.flatnonzero(end) + 1 - starts
        self.first = np.searchsorted(starts, offsets).astype(np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(places), pa.py_buffer(data[inside]))
        encoded = words.dictionary_encode()
        # Words in order, so that neighbouring strings are alike and compress well.
        order = pc.sort_indices(encoded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.code = encoded.dictionary.take(pa.array(order)), place[encoded.indices.to_numpy(zero_copy_only=False)]
        apart = np.ones(max(len(sizes) - 1, 0), bool)
        inner = self.first[1:-1]
        apart[inner[(inner > 0) & (inner < len(sizes))] - 1] = False
        self.keys = (self.code[:-1] << 32 | self.code[1:])[apart]

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def blocks(self, parts: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """The different features with their counts, dealt to ``parts`` by a hash: (part, features, bytes, strings, counts), compressed."""
        data, starts, sizes = self._word_bytes()
        state = crc_states(data, starts, sizes, np.full(len(sizes), _SIGNS)).astype(np.uint64)
        used = np.bincount(self.code, minlength=len(self.words))
        pairs, n = np.unique(self.keys, return_counts=True)
        one, two = pairs >> 32, pairs & 0xFFFFFFFF
        of_word = (common.mix(state) % np.uint64(parts)).astype(np.int64)
        of_pair = (common.mix(state[one] << np.uint64(32) | state[two]) % np.uint64(parts)).astype(np.int64)
        words, in_part = np.argsort(of_word, kind="stable"), np.argsort(of_pair, kind="stable")
        word_end, pair_end = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=parts))]) for x in (of_word, of_pair))
        for part in range(parts):
            w, p = words[word_end[part] : word_end[part + 1]], in_part[pair_end[part] : pair_end[part + 1]]
            if not len(w) + len(p):
                continue
            first, second = (self.words.take(pa.array(x[p])) for x in (one, two))
            joined = pc.binary_join_element_wise(first, second, pa.scalar(" ", pa.large_string()))
            strings = pa.concat_arrays([self.words.take(pa.array(w)), joined])
            raw = pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), pa.scalar("\n", strings.type))[0].as_buffer()
            counts = np.concatenate([used[w], n[p]]).tobytes()
            yield part, len(strings), raw.size, pa.compress(raw, "zstd", asbytes=True), pa.compress(counts, "zstd", asbytes=True)

    def _word_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offsets = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        return np.frombuffer(self.words.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Each text's sum of gains over its features; different features are hashed once."""
        data, starts, sizes = self._word_bytes()
        state = crc_states(data, starts, sizes, np.full(len(sizes), _SIGNS))
        gain = lambda s: gains[(s ^ _SIGNS).astype(np.int64) % len(gains)]
        pairs, place = np.unique(self.keys, return_inverse=True)
        one, two = pairs >> 32, pairs & 0xFFFFFFFF
        joined = crc_states(data, starts[two], sizes[two], _step(state, 32)[one])
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        by_word, by_pair = total(gain(state)[self.code]), total(gain(joined)[place])
        after = total(np.maximum(self.counts - 1, 0))
        return np.diff(by_word[self.first]) + np.diff(by_pair[after])


def _chunks(column: pa.Array) -> Iterator[pa.Array]:
    """Rows of a column, about ``_CHUNK_BYTES`` of text at a time; a longer text by itself."""
    _, offsets = common.utf8(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + _CHUNK_BYTES, side="right")) - 1
        last = min(max(last, row + 1), n)
        yield column.slice(row, last - row)
        row = last


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """A task's texts, joined to chunks of about ``_CHUNK_BYTES``: the more texts, the fewer features that only repeat others."""
    held, size = [], 0
    for batch in batches:
        for part in _chunks(batch.column(0)):
            held.append(part.cast(pa.large_string()))
            size += held[-1].nbytes
            if size >= _CHUNK_BYTES:
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(feature, n): every different feature of all texts with its count.

    Features travel by the thousand, compressed, to the part that a hash of the string gives; a part has about ``_PART_BYTES`` of
    text, however much there is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for column in _gathered(batches):
            for block in _Features(column).blocks(parts):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in block], ["part", "n", "size", "strings", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        strings, counts = [], []
        for n, size, packed, packed_counts in zip(*(table.column(c).to_pylist() for c in ("n", "size", "strings", "counts")), strict=True):
            whole = pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, size], np.int64)), pa.decompress(packed, size, "zstd"))
            strings.append(pc.split_pattern(whole, "\n").flatten())
            counts.append(pa.array(np.frombuffer(pa.decompress(packed_counts, 8 * n, "zstd"), np.int64)))
        summed = pa.table({"feature": pa.chunked_array(strings), "n": pa.chunked_array(counts)}).group_by("feature").aggregate([("n", "sum")])
        return pa.table({"feature": summed.column("feature").cast(pa.string()), "n": summed.column("n_sum")})

    own = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _PART_BYTES))
    blocks = own.mapInArrow(run, "part long, n long, size long, strings binary, counts binary")
    return blocks.repartition(parts, "part").groupBy("part").applyInArrow(merge, "feature string, n long")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): each string hashed once, counts summed by bucket."""
    bucket = F.crc32(F.col("feature").cast("binary")) % buckets
    return features.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of every bucket: a row each goes to the driver, ``buckets`` at most."""
    corpus = bucket_counts(dictionary(docs, text_col), buckets).withColumnRenamed("n", "s")
    wanted = bucket_counts(dictionary(target, target_col), buckets).withColumnRenamed("n", "t")
    counts = np.zeros((2, buckets), np.int64)
    with common.settings(docs.sparkSession):
        for bucket, s, t in corpus.join(wanted, "bucket", "full").collect():
            counts[:, bucket] = s or 0, t or 0
    (s, t), (all_s, all_t) = counts.astype(float), counts.sum(1).astype(float)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", names: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """``docs`` with the words, the features and the weight (mean gain, floored) of each text in columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` long" for n in names)])
    columns, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for column in _chunks(batch.column(place)):
                found = _Features(column)
                n = found.counts
                features = n + np.maximum(n - 1, 0)
                weight = found.sums(shared.value) // np.maximum(features, 1)
                own = batch.slice(at, len(column))
                at += len(column)
                yield pa.RecordBatch.from_arrays([*own.columns, *map(pa.array, (n, features, weight))], [*columns, *names])

    return docs.mapInArrow(run, schema)


def gumbel(doc_id, seed: str = SEED):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of seed and id."""
    key = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(scored: DataFrame, percent: int, least: int, tables: Tables) -> DataFrame:
    """``scored`` (doc_id, n_words, n_features, weight, score) with rank: rows that repeat are counted, ranked as one and dealt out again."""
    own = ["doc_id", "n_words", "n_features", "weight", "score"]
    groups = tables.cut(scored.groupBy(*own).agg(F.count("*").alias("copies")), "groups")
    fit = groups.filter(F.col("n_words") >= least)
    need = percent * (fit.agg(F.sum("copies")).first()[0] or 0) // 100
    # Rows of larger scores: of larger thousands, and of larger scores within a thousand; neither window grows with the rows.
    levels = fit.groupBy("score").agg(F.sum("copies").alias("_n")).withColumn("_thousand", F.shiftright("score", 10))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    larger = levels.groupBy("_thousand").agg(F.sum("_n").alias("_n")).select("_thousand", before(Window.orderBy(F.desc("_thousand"))).alias("_larger"))
    levels = levels.withColumn("_within", before(Window.partitionBy("_thousand").orderBy(F.desc("score")))).join(larger, "_thousand")
    levels = tables.cut(levels.select("score", (F.col("_larger") + F.col("_within")).alias("_before")), "levels").filter(F.col("_before") < need)
    place = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    drawn = fit.join(levels, "score").withColumn("_first", F.col("_before") + F.coalesce(F.sum("copies").over(place), F.lit(0)) + 1)
    rest = groups.join(levels, (F.col("n_words") >= least) & (groups["score"] == levels["score"]), "left_anti").withColumn("_first", F.lit(need + 1).cast("long"))
    every = drawn.select(*own, "copies", "_first").unionByName(rest)
    rank = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("copies") - 1))
    return every.select(*own, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= need, F.col("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where it isn't drawn.

    ``percent`` of the rows with ``least`` words or more are drawn (rounded down), the largest scores first.
    """
    tables = Tables(docs.sparkSession, "resample")
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    weighed = weigh(own, gains(own, target, buckets, "text", target_col)).drop("text")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return _ranked(scored, percent, least, tables).select(*COLUMNS)


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED,
         id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; of repeated rows at the edge all stay."""
    names = common.free(docs, "_words", "_features", "_weight", "_score", "_id", "_f", "_w")
    weighed = weigh(docs, gains(docs, target, buckets, text_col, target_col), text_col, tuple(names[:3]))
    weighed = weighed.withColumn(names[3], F.col(names[2]) + gumbel(F.col(id_col), seed))
    own = weighed.select(F.col(id_col).alias("doc_id"), *(F.col(n).alias(m) for n, m in zip(names[:4], ("n_words", "n_features", "weight", "score"), strict=True)))
    taken = _ranked(own, percent, least, Tables(docs.sparkSession, "resample")).filter("rank IS NOT NULL")
    taken = taken.select(F.col("doc_id").alias(names[4]), F.col("n_features").alias(names[5]), F.col("weight").alias(names[6])).distinct()
    same = F.col(id_col).eqNullSafe(F.col(names[4])) & (F.col(names[1]) == F.col(names[5])) & (F.col(names[2]) == F.col(names[6]))
    return weighed.join(taken, same, "left_semi").select(*(F.col(c) for c in docs.columns))
