"""Media columns (operator 10): telephony audio as 8-bit or 4-bit WAV files.

mu-law and A-law expand by 256-entry tables built from the companding rule, IMA ADPCM blocks of many files are
decoded together with numpy across blocks (one step per sample position, all blocks at once), and PCM is
resampled by linear interpolation and stored as 16-bit WAV.

``store_texts`` puts a text's padded UTF-8 bytes losslessly into a WAV file as they are: a sample each in mu-law and
A-law, blocks of one unit in ADPCM; the payload's crc32 chooses the format.  ``convert`` reads any such
files: the stored bytes, resampled PCM as a WAV file, and features of that.  The query writes the files to a
table, reads it, converts it, and takes its digests from the columns.  Files are converted a megabyte at a time,
a longer one alone.

Defined results: a null text is empty; an empty payload is one unit of padding; equal texts give equal
values whatever their row; texts of any length are read whole; an empty table gives no rows; extra columns are
not read by ``store_texts`` and stay in ``convert``, but for those named like its results, which give way to them; null
media, and bytes that are no such file, give null results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17  # registered WAVE format tags
#: Bits of a stored sample, by format.
BITS = {PCM: 16, A_LAW: 8, MU_LAW: 8, IMA_ADPCM: 4}
UNIT, RATE, STORED_RATE = 192, 8_000, 16_000
#: Formats of stored texts, by the payload's crc32.
FORMATS = (MU_LAW, A_LAW, IMA_ADPCM)
#: Bytes of media that are converted at a time; a longer file is converted alone.
_AT_ONCE = 1 << 20
#: What ``convert`` adds.
RESULTS = T.StructType([T.StructField("samples", T.BinaryType()), T.StructField("pcm_wav", T.BinaryType()), T.StructField("feature", T.StringType())])


def _mu_law_table() -> np.ndarray:
    """G.711: bits are inverted; sign, 3-bit segment, 4-bit step; bias 33 at 14 bits, scaled to 16."""
    code = ~np.arange(256) & 0xFF
    magnitude = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
    return (np.where(code & 128, -magnitude, magnitude) * 4).astype(np.int16)


def _a_law_table() -> np.ndarray:
    """G.711: even bits are inverted; the lowest segment is linear; 13 bits scaled to 16."""
    code = np.arange(256) ^ 0x55
    segment, step = code >> 4 & 7, code & 15
    magnitude = np.where(segment == 0, step * 2 + 1, (step * 2 + 33) << np.maximum(segment - 1, 0))
    return (np.where(code & 128, magnitude, -magnitude) * 8).astype(np.int16)


TABLES = {MU_LAW: _mu_law_table(), A_LAW: _a_law_table()}


# The 89 step sizes and the index changes of IMA ADPCM.
_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _adpcm_step(value: np.ndarray, index: np.ndarray, nibble: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = _STEPS[index]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
    return value, np.clip(index + _INDEX[nibble & 7], 0, 88)


def _decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples (n, 2 * (size - 4) + 1) of n blocks of one size, all at once."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    nibbles = np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1)
    steps = np.ascontiguousarray(nibbles.T)
    out = np.empty((len(steps) + 1, len(blocks)), np.int16)
    out[0] = value
    for i, nibble in enumerate(steps, 1):
        value, index = _adpcm_step(value, index, nibble)
        out[i] = value
    return np.ascontiguousarray(out.T)


def decode_adpcm_files(files: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """Mono IMA ADPCM of several (data, block size).

    A block has a 16-bit first sample, an index, a zero byte, then two samples a byte, low half first.
    The last block may be short; a rest of under 4 bytes holds no sample and is passed over.
    """
    parts: list[list[np.ndarray]] = [[] for _ in files]
    for block in {block for _, block in files}:
        own = [(i, len(data) // block) for i, (data, size) in enumerate(files) if size == block and len(data) >= block]
        if own:
            whole = b"".join(files[i][0][: n * block] for i, n in own)
            pcm, at = _decode_blocks(np.frombuffer(whole, np.uint8).reshape(-1, block)), 0
            for i, n in own:
                parts[i].append(pcm[at : at + n].reshape(-1))
                at += n
    for i, (data, block) in enumerate(files):
        rest = len(data) % block
        if rest >= 4:
            parts[i].append(_decode_blocks(np.frombuffer(data, np.uint8, rest, len(data) - rest).reshape(1, rest)).reshape(-1))
    return [np.concatenate(x) if x else np.zeros(0, np.int16) for x in parts]


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    return decode_adpcm_files([(data, block)])[0]


def encode_adpcm(pcm: np.ndarray, block: int) -> bytes:
    """The inverse as near as the format allows; the last block repeats its last sample to full length."""
    per = (block - 4) * 2 + 1
    if not len(pcm):
        return b""
    n = -(-len(pcm) // per)
    x = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1])]).reshape(n, per).astype(np.int64)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    value, index = x[:, 0], np.zeros(n, np.int64)
    for i in range(1, per):
        step, gap = _STEPS[index], x[:, i] - value
        nibble, gap = np.where(gap < 0, 8, 0), np.abs(gap)
        for bit in (4, 2, 1):
            on = gap >= step
            nibble, gap, step = nibble + np.where(on, bit, 0), gap - np.where(on, step, 0), step >> 1
        value, index = _adpcm_step(value, index, nibble)
        out[:, 4 + (i - 1) // 2] |= (nibble << (4 * ((i - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def write_wav(data: bytes, tag: int, rate: int, bits: int, block: int) -> bytes:
    """A mono WAVE file."""
    per_second = rate * block if tag != IMA_ADPCM else rate * block // ((block - 4) * 2 + 1)
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, stored bytes); ValueError if it is no WAVE file of one channel in a known format."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or at + 8 + size > len(media):
                break
            if form[1] != 1 or form[5] != BITS.get(form[0]) or not form[2] or form[4] < (4 if form[0] == IMA_ADPCM else 1):
                raise ValueError(f"format {form[0]} with {form[1]} channels of {form[5]} bits is not telephony audio")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode_files(files: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """16-bit PCM of several (format tag, block size, stored bytes)."""
    packed = [i for i, (tag, *_) in enumerate(files) if tag == IMA_ADPCM]
    out: list = [None] * len(files)
    for i, pcm in zip(packed, decode_adpcm_files([(files[i][2], files[i][1]) for i in packed]), strict=True):
        out[i] = pcm
    for i, (tag, _, data) in enumerate(files):
        if tag in TABLES:
            out[i] = TABLES[tag][np.frombuffer(data, np.uint8)]
        elif tag == PCM:
            out[i] = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    return out


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit PCM) of a mono WAVE file in PCM, mu-law, A-law or IMA ADPCM."""
    tag, rate, block, data = read_wav(media)
    return rate, decode_files([(tag, block, data)])[0]


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to round(len * to / rate) samples, exact in integers (floor of the true value)."""
    n = (len(pcm) * to + rate // 2) // rate
    if not len(pcm) or not n:
        return np.zeros(0, np.int16)
    at = np.arange(n, dtype=np.int64) * rate
    left = np.minimum(at // to, len(pcm) - 1)
    right = np.minimum(left + 1, len(pcm) - 1)
    part = at - left * to
    a, b = pcm[left].astype(np.int64), pcm[right].astype(np.int64)
    return (a + (b - a) * np.minimum(part, to) // to).astype(np.int16)


def features(pcm: np.ndarray, rate: int) -> str:
    """Samples, rate, peak, mean square, sign changes: integers only, the same on every machine."""
    x = pcm.astype(np.int64)
    square = int((x * x).sum()) // max(len(x), 1)
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};rate={rate};peak={int(np.abs(x).max(initial=0))};ms={square};zc={changes}"


def converted(media: list[bytes | None], rate: int = STORED_RATE) -> list[tuple]:
    """(stored bytes, PCM at ``rate`` as a WAV file, its features) of each file; Nones where there is no telephony audio."""
    read: list[tuple | None] = []
    for m in media:
        try:
            read.append(read_wav(m))
        except (ValueError, TypeError, struct.error):
            read.append(None)
    pcms = iter(decode_files([(tag, block, data) for tag, _, block, data in filter(None, read)]))
    out = []
    for x in read:
        if x is None:
            out.append((None, None, None))
            continue
        wav = write_wav(resample(next(pcms), x[1], rate).astype("<i2").tobytes(), PCM, rate, 16, 2)
        out.append((x[3], wav, features(np.frombuffer(read_wav(wav)[3], "<i2"), rate)))
    return out


def to_pcm_wav(media: bytes, rate: int = STORED_RATE) -> bytes:
    """Any of the formats as 16-bit PCM at ``rate``."""
    if (wav := converted([media], rate)[0][1]) is None:
        raise ValueError("not a telephony WAVE file")
    return wav


def convert(media: DataFrame, media_col: str = "media", rate: int = STORED_RATE) -> DataFrame:
    """``media`` with samples (the stored bytes), pcm_wav and feature; null where the bytes are null or no telephony audio."""
    media = media.drop(*RESULTS.names)
    at = media.columns.index(media_col)
    names = [*media.columns, *RESULTS.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([0, *(len(x) if x is not None else 0 for x in batch.column(at).to_pylist())])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + _AT_ONCE, side="right")) - 1)
                part = batch.slice(lo, hi - lo)
                columns = list(zip(*converted(part.column(at).to_pylist(), rate), strict=True))
                kinds = (pa.binary(), pa.binary(), pa.string())
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)
                lo = hi

    return media.mapInArrow(run, T.StructType([*media.schema.fields, *RESULTS.fields]))


def store(text: str | None, unit: int = UNIT) -> tuple[int, bytes]:
    """(bytes of the text, a WAV file that holds them, padded with spaces to a positive multiple of ``unit``)."""
    raw = (text or "").encode()
    payload = raw.ljust(max(unit, -(-len(raw) // unit) * unit))
    tag = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    return len(raw), write_wav(payload, tag, RATE, BITS[tag], unit if tag == IMA_ADPCM else 1)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as the samples of a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows = [store(text, unit) for text in part.column(1).to_pylist()]
                arrays = [part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([m for _, m in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")
