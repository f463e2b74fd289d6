"""Shared parts of the training-data operators: tables of a run, free column names, and word hashing.

Words are hashed from the UTF-8 buffer of an Arrow string column.  Eight bytes at a time of all words go
through a keyed bijective mixer that follows the bytes before, so equal hashes of different words are chance
(one in 2**64 for a lane, one in 2**128 for both), whatever the words look like.  Words of more than ``_LONG``
bytes are hashed one by one.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: White space of the word contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_KEYS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_LONG = 64
_CHUNK_BYTES = 1 << 21


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexiflow-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/lexiflow-{name}-{uuid.uuid4().hex}"


class Tables:
    """Tables that one run writes to the shared folder, so that lost executors cost nothing; ``drop`` deletes those that are done with."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.number = spark, scratch(spark, name), 0
        self.paths: dict[str, str] = {}

    def new_path(self, name: str) -> str:
        self.number += 1
        self.paths[name] = f"{self.path}/{self.number:03d}-{name}"
        return self.paths[name]

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back: its lineage ends."""
        path = self.new_path(name)
        with settings(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """One table of its own."""
    return Tables(df.sparkSession, name).cut(df, name)


#: Settings of queries that write tables: shuffle files go when their query ends, not with the driver's next collection, and
#: what is sent to Python at a time is small, for JVM buffers and workers do not shrink again.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str] = _SETTINGS) -> Iterator[None]:
    """The session with these settings, and then with its own again."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 (wraps around)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of some consecutive rows: bytes, spans, hashes and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.raw = data
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[0] = True
        edge[offsets] = True  # a row's end ends its word
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        size = ends - starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))
        out = mix(size.astype(np.uint64) * np.uint64(_KEYS[1 - lane] | 1) + np.uint64(_KEYS[lane]))
        out = mix(out ^ (eights[starts] & _BYTES[np.minimum(size, 8)]))
        left = np.flatnonzero((size > 8) & (size <= _LONG))
        for done in range(8, _LONG, 8):
            out[left] = mix(out[left] ^ (eights[starts[left] + done] & _BYTES[np.minimum(size[left] - done, 8)]))
            left = left[size[left] > done + 8]
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]].data, _KEYS[lane])
        return out

    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, lower: bool, chunk_bytes: int = _CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(first row, Words) for runs of rows of about ``chunk_bytes``; a longer text is a run of its own."""
    raw, offsets = utf8(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        last = min(max(last, row + 1), n)
        lo, hi = int(offsets[row]), int(offsets[last])
        yield row, Words(raw[lo:hi], offsets[row : last + 1] - lo, lower)
        row = last
