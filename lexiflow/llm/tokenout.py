"""Token-ID output in training order (operator 7).

A first pass counts the ids of every input partition.  Partition counts fix how many sequences there are
and the number of each.  A keyed Feistel permutation with cycle-walking gives every sequence a slot among
exactly as many, so no sort or shuffle index of the data is needed.  A second pass encodes again, cuts each
partition's stream into windows, and sends them by slot range to one task per shard, which writes a file
of fixed stride: sequence ``slot`` stands at byte ``(slot - first slot) * stride`` of its shard.  Readers
seek to any slot and read on sequentially; ``manifest.json`` is written last and marks a whole output.

Encoding twice moves the ids once and stores them once; an intermediate copy would cost more disk than
the count costs time.  A task owns a range of shards, so there are at most ``MAX_TASKS`` of them however many
shards there are.  A shard is written under a name of its attempt and then renamed: lost tasks leave no partial
shard, a second attempt finds the same bytes in place, and what attempts left is deleted at the end.  Every
file is in the file system that Spark resolves ``path`` to.  The driver keeps one count per partition.

Defined results: a null or empty text is its closing id alone; each partition's last sequence is filled up
with ``PAD``; repeated rows are written as rows of their own; an empty table gives no shards and a
manifest; extra columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, mix, scratch
from lexiflow.llm.tokens import encoder, ship

WINDOW, CLOSE, PAD, KEY, SHARD_SEQUENCES, ROUNDS = 2048, 1, 0, 20_240_229, 4096, 6
#: Cached words per worker: two passes meet every word, and nothing else needs memory here, so more than ``tokens`` keeps.
CACHE_WORDS = 2_000_000
#: Tasks that write shards, at most.
MAX_TASKS = 20_000
_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("offset", pa.int32()), ("length", pa.int32())])
_INDEX = ("doc_id", "start", "length", "ids_crc32", "slot", "offset", "shard", "byte_offset")


def feistel(index: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """A permutation of 0..n-1 that ``key`` chooses, or its inverse; values that fall outside walk on along their cycle."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    rounds = mix(np.arange(ROUNDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for k in rounds[::-1] if back else rounds:
            if back:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        return left << bits | right

    out = once(np.asarray(index, np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


@dataclass
class Output:
    path: str
    sequences: int
    shard_sequences: int
    stride: int
    #: One row per document and sequence: doc_id, start (ids of it before), length, ids_crc32, slot, offset, shard, byte_offset.
    index: DataFrame


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """Spark's file system for a path, and the whole path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark resolves it to."""
    whole = _hadoop(spark, path)[1].toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _filesystem(path: str):
    """The file system of a path with a scheme; one without is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def publish(system, temporary: str, name: str) -> None:
    """Gives a whole shard its name.  Where another attempt was first its file, of the same bytes, stays."""
    from pyarrow import fs

    try:
        system.move(temporary, name)
    except OSError:
        if system.get_file_info(name).type != fs.FileType.File:
            raise
        system.delete_file(temporary)


def materialise(
    docs: DataFrame, path: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, key: int = KEY, shard_sequences: int = SHARD_SEQUENCES, wide: bool = False,
) -> Output:
    """Writes the shards below ``path`` (a shared folder; else one of its own).  ``wide``: 32-bit ids, else 16-bit."""
    spark = docs.sparkSession
    splits = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    # Splits of files depend on the cores there are; both passes must see the same ones.
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", splits or spark.sparkContext.defaultParallelism)
    try:
        return _materialise(docs, path, tokenizer, id_col, text_col, window, key, shard_sequences, wide)
    finally:
        if splits is None:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def _materialise(docs, path, tokenizer, id_col, text_col, window, key, shard_sequences, wide) -> Output:
    spark = docs.sparkSession
    path, shipped = qualified(spark, path or scratch(spark, "tokens")), ship(spark, tokenizer)
    _delete(spark, f"{path}/manifest.json")
    dtype = np.dtype("<u4" if wide else "<u2")
    stride = window * dtype.itemsize
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            n += int(encoder(shipped, CACHE_WORDS).counts(batch.column(1)).sum()) + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], ["part", "ids"])

    counts = {r.part: r.ids for r in rows.mapInArrow(count, "part long, ids long").collect()}
    first, total = {}, 0
    for part in sorted(counts):
        first[part] = total
        total += -(-counts[part] // window)
    shards = -(-total // shard_sequences)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, seen = first.get(part, 0), 0
        held, pieces, size = [], [], 0

        def cut_off(ids: np.ndarray, of: list[tuple]) -> tuple:
            nonlocal number
            number += 1
            full = np.full(window, PAD, dtype)
            full[: len(ids)] = ids
            return number - 1, full.tobytes(), of

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            slots = feistel(np.array([x[0] for x in out]), total, key)
            listed = [[dict(zip(_PIECE.names, p, strict=True)) for p in x[2]] for x in out]
            shards_of = pa.array((slots // shard_sequences).astype(np.int32))
            arrays = [pa.array(slots), shards_of, pa.array([x[1] for x in out], pa.binary()), pa.array(listed, pa.list_(_PIECE))]
            return pa.RecordBatch.from_arrays(arrays, ["slot", "shard", "ids", "pieces"])

        for batch in batches:
            doc_ids, out = batch.column(0).to_pylist(), []
            for row, ids, offsets in encoder(shipped, CACHE_WORDS).encode(batch.column(1)):
                if not wide and len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("ids of this vocabulary need wide=True")
                closed = np.insert(ids, offsets[1:], CLOSE)
                offsets = (offsets + np.arange(len(offsets))).tolist()
                seen += len(closed)
                for i in range(len(offsets) - 1):
                    at, end = offsets[i], offsets[i + 1]
                    while at < end:
                        take = min(end - at, window - size)
                        pieces.append((doc_ids[row + i], at - offsets[i], size, take))
                        held.append(closed[at : at + take])
                        size, at = size + take, at + take
                        if size == window:
                            out.append(cut_off(np.concatenate(held), pieces))
                            held, pieces, size = [], [], 0
                held = [np.concatenate(held)] if held else []
                if len(out) >= 512:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
        if seen != counts.get(part, 0):
            raise RuntimeError("the input's partitions changed between the two passes")
        if size:
            yield batch_of([cut_off(np.concatenate(held), pieces)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, expected, name, temporary = None, -1, 0, "", ""
        system, root = _filesystem(path)
        attempt = TaskContext.get().taskAttemptId()

        def close() -> None:
            out.close()
            publish(system, temporary, name)

        for batch in batches:
            lines = []
            for slot, own, ids, pieces in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if own != shard:
                    if out is not None:
                        close()
                    shard, expected, name = own, own * shard_sequences, f"{root}/shard-{own:06d}.bin"
                    temporary = f"{root}/_attempts/shard-{own:06d}.{attempt}"
                    system.create_dir(f"{root}/_attempts", recursive=True)
                    out = system.open_output_stream(temporary)
                if slot != expected:
                    raise RuntimeError(f"slot {expected} of shard {shard} is missing")
                out.write(ids)
                expected += 1
                at = (slot - shard * shard_sequences) * stride
                for p in pieces:
                    b = p["offset"] * dtype.itemsize
                    crc = zlib.crc32(np.frombuffer(ids, dtype, p["length"], b).astype("<u4"))
                    lines.append((p["doc_id"], p["start"], p["length"], crc, slot, p["offset"], shard, at + b))
            columns = zip(*lines, strict=True) if lines else [()] * len(_INDEX)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_INDEX))
        if out is not None:
            close()

    piece = "array<struct<doc_id: long, start: long, offset: int, length: int>>"
    schema = ", ".join(f"{name} long" for name in _INDEX)
    if total:
        own = -(-shards // min(shards, MAX_TASKS))  # shards of a task
        sent = rows.mapInArrow(sequences, f"slot long, shard int, ids binary, pieces {piece}")
        sent = sent.repartitionById(-(-shards // own), F.floor(F.col("shard") / own).cast("int")).sortWithinPartitions("slot")
        index = cut(sent.mapInArrow(write, schema), "token-index")
        _delete(spark, f"{path}/_attempts")
    else:
        index = spark.createDataFrame([], schema)
    manifest = {
        "sequences": total, "window": window, "stride": stride, "dtype": dtype.str, "shard_sequences": shard_sequences,
        "shards": shards, "key": key, "pad": PAD,
    }
    _put(spark, f"{path}/manifest.json", json.dumps(manifest))
    return Output(path, total, shard_sequences, stride, index)


def _put(spark: SparkSession, name: str, text: str) -> None:
    """A small file, by Spark's own file system."""
    system, path = _hadoop(spark, name)
    out = system.create(path, True)
    out.write(bytearray(text.encode()))
    out.close()


def _delete(spark: SparkSession, name: str) -> None:
    system, path = _hadoop(spark, name)
    system.delete(path, True)


def read_sequences(path: str, slot: int, n: int) -> np.ndarray:
    """``n`` sequences from ``slot`` on, fewer at the end; (n, window) ids."""
    system, root = _filesystem(path)
    with system.open_input_file(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    out, end = [], min(slot + n, m["sequences"])
    while slot < end:
        shard = slot // m["shard_sequences"]
        k = min(end, (shard + 1) * m["shard_sequences"]) - slot
        with system.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek((slot - shard * m["shard_sequences"]) * m["stride"])
            out.append(np.frombuffer(f.read(k * m["stride"]), m["dtype"]).reshape(k, m["window"]))
        slot += k
    return np.concatenate(out) if out else np.zeros((0, m["window"]), m["dtype"])
