"""Packing (operator 8): fixed token windows by Karmarkar-Karp multiway differencing.

Every partition is read as a stream.  Documents are cut into pieces: runs of ``window`` ids fill a
sequence alone, the rest is cut into pieces of at most ``piece`` ids.  Pieces gather in a group until
it holds ``windows * (window - slack)`` ids exactly (the last piece is cut there; its other part opens
the next group), and multiway differencing splits a group into near-equal windows.  Where a window
would exceed its capacity, the window count rises and the group is split again.

Nothing is shuffled: a group lies in one partition, so memory is one group and one Arrow batch however
large or skewed the input is, and a lost task reruns alone with the same result.

Defined results: a null or empty text is one piece with the closing id alone; repeated rows and
repeated or null ids are packed as rows of their own; an empty table gives no rows; columns other
than the two named are not read.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexiflow.llm.tokens import encoder, ship

WINDOW = 2048
#: The closing id of every document.
CLOSE = 1
#: Longest piece of a document's rest, windows per group, and ids left free per window on average.
PIECE, GROUP_WINDOWS, SLACK = 512, 256, 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _merge(a: list, b: list, k: int) -> list:
    """Two partial partitions, opposing loads together; both and the result have falling loads."""
    both = len(a) + len(b) - k
    if both <= 0:
        return sorted(a + b, key=lambda x: -x[0])
    # The lightest of each meet in opposite order; the empty windows of one take the heaviest of the other.
    met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - both :], reversed(b[len(b) - both :]), strict=True)]
    return sorted(a[: len(a) - both] + b[: len(b) - both] + met, key=lambda x: -x[0])


def _leaves(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            out.append(x)
    return sorted(out)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of each of at most ``k`` windows of near-equal load.

    Sets of windows whose loads differ most are merged first, heavy with light.  Ties go by item number.
    """
    if not sizes:
        return []
    order = itertools.count()
    spread = lambda p: p[0][0] - (p[-1][0] if len(p) == k else 0)
    heap = [(-s if k > 1 else 0, next(order), [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = _merge(a, b, k)
        heapq.heappush(heap, (-spread(merged), next(order), merged))
    return [_leaves(tree) for _, tree in heap[0][2]]


def pack(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows of at most ``capacity``; their count starts at the least possible and rises while one is over it.

    The count rises by steps that double, so an awkward group takes few tries; each size must be at most ``capacity``.
    """
    k, step = max(1, -(-sum(sizes) // capacity)), 1
    while True:
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k, step = k + step, step * 2


class _Packer:
    """The pieces of one partition."""

    def __init__(self, window: int, piece: int, windows: int, slack: int, partition: int):
        self.window, self.piece, self.limit = window, piece, windows * (window - slack)
        self.sequence = partition << 32
        self.pieces: list[tuple] = []
        self.total = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        n = len(ids)
        whole = n - n % self.window
        for start in range(0, whole, self.window):
            yield (doc_id, start, self.window, zlib.crc32(ids[start : start + self.window]), n, self.sequence, 0)
            self.sequence += 1
        start = whole
        while start < n:
            length = min(n - start, self.piece, self.limit - self.total)
            self.pieces.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), n))
            start += length
            self.total += length
            if self.total == self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        for members in pack([p[2] for p in self.pieces], self.window):
            offset = 0
            for i in members:
                yield (*self.pieces[i], self.sequence, offset)
                offset += self.pieces[i][2]
            self.sequence += 1
        self.pieces, self.total = [], 0


def pack_documents(
    docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, slack: int = SLACK,
) -> DataFrame:
    """One row per piece: document, its place there, the crc32 of its ids, and its place in a sequence."""
    shipped = ship(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(shipped)
        packer = _Packer(window, piece, group_windows, slack, TaskContext.get().partitionId())
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for part in batches:
            ids_of = part.column(0).to_pylist()
            for row, ids, offsets in words.encode(part.column(1)):
                closed = np.insert(ids, offsets[1:], CLOSE).astype("<u4")
                offsets = (offsets + np.arange(len(offsets))).tolist()
                for i in range(len(offsets) - 1):
                    rows += packer.add(ids_of[row + i], closed[offsets[i] : offsets[i + 1]])
                if len(rows) >= 20_000:
                    yield batch()
                    rows.clear()
        rows += packer.flush()
        if rows:
            yield batch()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
