"""Personal data (operator 11): four patterns, and a character-level bidirectional LSTM with CRF transitions.

Patterns give the base spans of four kinds: e-mail addresses, IPv4 addresses, card numbers (13 to 19 digits that pass Luhn's
check) and telephone numbers.  The tagger finds other spellings of them.  It is trained here, in numpy, from labelled spans:
windows of at most ``MAX_WINDOWS`` labelled ones, drawn by hash, and as many with spans in other spellings.  A card's label is
its shape, for no character model can add up a checksum; that is looked at after decoding.

Reading: windows of ``WIDE`` characters, each half over the next, lie on a grid over the whole text.  Every span holds a digit
or an ``@`` by definition, so windows without one have no span and are not decoded; all others are.  Best tag sequences
(Viterbi) give spans with a weight, the sum by which their characters' tags beat no tag.  What a window's edge cuts gives way to what a
neighbour sees whole, or is joined to the neighbour's piece; of all spans of a text the set without overlaps and with the
largest sum of weights stays (dynamic programming over the text).  A decoded span counts if it fits its kind (``fits``), no letter
or digit touches it and no base span overlaps it.

Defined results: a null or empty text has no spans; places are code points, ends exclusive; texts of any length are read
whole, a batch of windows at a time; repeated rows give repeated rows; copies are learnt from once; without labelled spans to learn
from (an empty table) nothing is added to the base; extra columns stay, but for one named like the result, which gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm import common

KINDS = ("email", "ip", "card", "phone")
WIDE, HALF, MAX_WINDOWS, HIDDEN, SIZE, EPOCHS, BATCH, RATE = 96, 48, 1500, 20, 12, 10, 128, 0.02
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and its digits summed, and the others add up to tens."""
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def fits(kind: str, text: str, shape: bool = False) -> bool:
    """Whether a text may be a span of the kind; ``shape``: a card's checksum aside."""
    parts = _DIGITS.findall(text)
    digits = "".join(parts)
    if kind == "email":
        local, _, domain = text.partition("@")
        return "@" not in domain and any(c.isalnum() for c in local) and bool(re.search(r"[A-Za-z0-9]\W*\.\W*[A-Za-z0-9]", domain))
    if kind == "ip":
        return len(parts) == 4 and all(map(_byte, parts)) and not re.search("[A-Za-z]", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and (shape or luhn(digits)) and not re.search("[A-Za-z]", text)
    return 7 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address begins with the run of such characters before its @, as far as no address took them; linear."""
    past, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > past and text[first - 1] in _LOCAL_CHARS:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            yield first, found.end()
        past = found.end() if found else at + 1
        at = text.find("@", past)


def base_spans(text: str, shape: bool = False) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that do not overlap within a kind, failing ones dropped."""
    out = [("email", *m) for m in _emails(text)]
    out += (("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split("."))))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and (shape or luhn(digits)):
            out.append(("card", *m.span()))
    out += (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15)
    return out


# Characters: digits are one, ASCII letters and marks each their own, white space two, letters beyond ASCII and the rest one each.
PAD, _DIGIT, _BLANK, _LINE, _LETTER, _OTHER = range(6)
_ALPHABET = 6 + 95
_CLASS = np.full(128, _BLANK, np.int64)
_CLASS[33:127] = 6 + np.arange(94)
_CLASS[48:58] = _DIGIT
_CLASS[[10, 13]] = _LINE
_AT = int(_CLASS[ord("@")])
TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    beyond = np.where(points < 0x2000, _LETTER, _OTHER)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], beyond)


def window_starts(code: np.ndarray) -> np.ndarray:
    """Places of the grid whose windows hold a digit or an @."""
    at = np.unique(np.flatnonzero((code == _DIGIT) | (code == _AT)) // HALF)
    return np.unique(np.concatenate([at, at - 1])[np.concatenate([at, at - 1]) >= 0]) * HALF


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _allowed() -> np.ndarray:
    """Transitions that are no spans: to an inside from anything but the same kind."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        out[[t for t in range(TAGS) if t not in (inside - 1, inside)], inside] = -1e4
    return out


_FORBIDDEN = _allowed()


@dataclass
class Tagger:
    """Embedding, two LSTMs (one from the right), and a linear chain over tags; directions are computed side by side."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, rng: np.random.Generator, hidden: int = HIDDEN, size: int = SIZE) -> Tagger:
        draw = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[..., hidden : 2 * hidden] = 1.0  # memory is kept at first
        return cls({
            "embed": draw(_ALPHABET, size, by=1), "x": draw(2, size, 4 * hidden, by=size), "h": draw(2, hidden, 4 * hidden, by=hidden), "bias": bias,
            "out": draw(2 * hidden, TAGS, by=2 * hidden), "out_bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32),
        })

    def states(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states of both directions, [2, windows, places, hidden], each in its own order, and what a step back needs."""
        p, n = self.p, self.p["h"].shape[1]
        both = np.stack([ids, ids[:, ::-1]])
        given = np.matmul(p["embed"][both], p["x"][:, None]) + p["bias"][:, None]
        h = c = np.zeros((2, len(ids), n), np.float32)
        out, kept = np.empty((2, *ids.shape, n), np.float32), []
        for t in range(ids.shape[1]):
            g = given[:, :, t] + h @ p["h"]
            gate, fresh = _sigmoid(g[..., : 3 * n]), np.tanh(g[..., 3 * n :])
            before, c = c, gate[..., n : 2 * n] * c + gate[..., :n] * fresh
            seen = np.tanh(c)
            kept.append((h, before, gate, fresh, seen))
            h = gate[..., 2 * n :] * seen
            out[:, :, t] = h
        return out, kept

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        out, kept = self.states(ids)
        joined = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        return joined @ self.p["out"] + self.p["out_bias"], joined, kept

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients."""
        p, (rows, length) = self.p, ids.shape
        scores, joined, kept = self.emissions(ids)
        step = p["step"] + _FORBIDDEN
        # Forward and backward sums over tag sequences.
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, length):
            alpha[:, t] = scores[:, t] + _log_sum(alpha[:, t - 1, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _log_sum(step + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        whole = _log_sum(alpha[:, -1], 1)
        at = np.arange(rows)[:, None], np.arange(length)[None, :]
        pairs = np.exp(alpha[:, :-1, :, None] + step + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        gold = scores[(*at, tags)].sum(1) + step[tags[:, :-1], tags[:, 1:]].sum(1)
        d_scores = np.exp(alpha + beta - whole[:, None, None])
        d_scores[(*at, tags)] -= 1
        d_step = pairs.sum((0, 1))
        np.subtract.at(d_step, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        d_scores /= rows
        grad = {"step": d_step / rows, "out": np.tensordot(joined, d_scores, ((0, 1), (0, 1))), "out_bias": d_scores.sum((0, 1))}
        d_joined = d_scores @ p["out"].T
        grad |= self._back(ids, d_joined, kept)
        return float((whole - gold).mean()), grad

    def _back(self, ids: np.ndarray, d_joined: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        p, n, length = self.p, self.p["h"].shape[1], ids.shape[1]
        d_out = np.stack([d_joined[..., :n], d_joined[:, ::-1, n:]])
        d_given = np.empty((2, len(ids), length, 4 * n), np.float32)
        d_h = d_c = np.zeros((2, len(ids), n), np.float32)
        grad_h = np.zeros_like(p["h"])
        for t in range(length - 1, -1, -1):
            h, before, gate, fresh, seen = kept[t]
            enter, keep, show = gate[..., :n], gate[..., n : 2 * n], gate[..., 2 * n :]
            d_h = d_h + d_out[:, :, t]
            d_c = d_c + d_h * show * (1 - seen**2)
            d_gate = np.concatenate([d_c * fresh, d_c * before, d_h * seen], axis=2) * gate * (1 - gate)
            d_g = np.concatenate([d_gate, d_c * enter * (1 - fresh**2)], axis=2)
            d_given[:, :, t] = d_g
            grad_h += h.transpose(0, 2, 1) @ d_g
            d_h, d_c = d_g @ p["h"].transpose(0, 2, 1), d_c * keep
        both = np.stack([ids, ids[:, ::-1]])
        flat = d_given.reshape(2, -1, 4 * n)
        grad_x = p["embed"][both].reshape(2, -1, p["embed"].shape[1]).transpose(0, 2, 1) @ flat
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, both.reshape(-1), (flat @ p["x"].transpose(0, 2, 1)).reshape(-1, embed.shape[1]))
        return {"h": grad_h, "x": grad_x, "bias": flat.sum(1, keepdims=True), "embed": embed}

    def best_tags(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, by how much each place's tag beats no tag) of every window: Viterbi."""
        scores, _, _ = self.emissions(ids)
        step, length = self.p["step"] + _FORBIDDEN, ids.shape[1]
        from_, best = np.empty(scores.shape, np.int8), scores[:, 0].copy()
        best[:, 2::2] = -1e4  # no window begins inside by itself; what its edge cuts begins there
        for t in range(1, length):
            over = best[:, :, None] + step
            from_[:, t] = over.argmax(1)
            best = over.max(1) + scores[:, t]
        tags = np.empty(ids.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(ids))
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = from_[rows, t, tags[:, t]]
        margin = np.take_along_axis(scores, tags[..., None], 2)[..., 0] - scores[..., 0]
        return tags, margin


def train(ids: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, seed: int = 1, rate: float = RATE) -> Tagger:
    """Adam over shuffled batches, the rate falling to a tenth; the same windows in the same order give the same tagger."""
    rng = np.random.default_rng(seed)
    tagger = Tagger.new(rng)
    first, second, done = ({k: np.zeros_like(v) for k, v in tagger.p.items()} for _ in range(2)), None, 0
    first, second = first
    steps = epochs * -(-len(ids) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), batch):
            own = order[at : at + batch]
            _, grad = tagger.loss(ids[own], tags[own])
            size = np.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in grad.values()))
            done += 1
            now = rate * (1 - 0.9 * done / steps)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                change = first[k] / (1 - 0.9**done) / (np.sqrt(second[k] / (1 - 0.99**done)) + 1e-8)
                tagger.p[k] = (tagger.p[k] - now * change).astype(np.float32)
    return tagger


def _spelled(kind: str, text: str, rng: np.random.Generator) -> str:
    """Another spelling of a span, its digits drawn anew."""
    pick = lambda *of: of[int(rng.integers(len(of)))]
    text = _DIGITS.sub(lambda m: "".join(str(int(rng.integers(10))) for _ in m[0]), text)
    digits = "".join(_DIGITS.findall(text))
    if kind == "email":
        return text.replace("@", pick("@", " @ ", "@ ", "[@]", "(@)")).replace(".", pick(".", ".", " . "))
    if kind == "ip":
        return pick(".", " . ", ". ", " .", "[.]").join(str(int(rng.integers(256))) for _ in range(4))
    if kind == "card":
        gap = pick("", " ", "-", ".", "  ", "/", " - ")
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, head, tail = digits[-10:-7], digits[-7:-4], digits[-4:]
    gap = pick("-", " ", ".", "/", " - ")
    return pick(f"({area}) {head}{gap}{tail}", gap.join((area, head, tail)), f"+{digits[:1]}{gap}{area}{gap}{head}{gap}{tail}", f"00{digits[:1]} {area} {head} {tail}")


def _example(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of one window."""
    ids, tags = np.full(WIDE, PAD, np.int64), np.zeros(WIDE, np.int64)
    own = codes(text[:WIDE])
    ids[: len(own)] = own
    for kind, start, end in spans:
        if start < WIDE:
            tags[start:end] = 2 + 2 * KINDS.index(kind)
            tags[start] -= 1
    return ids, tags


def _examples(rows: list[tuple[str, list[tuple[str, int, int]]]], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows as they stand, and as many again as have spans, in other spellings."""
    rng, out = np.random.default_rng(seed), []
    with_spans = [r for r in rows if r[1]]
    repeat = max(1, min(8, 1200 // max(len(with_spans), 1)))
    for text, spans in rows:
        out.append(_example(text, spans))
        for _ in range(repeat if spans else 0):
            new, placed, at = "", [], 0
            for kind, start, end in sorted(spans, key=lambda s: s[1]):
                if start < at:
                    continue
                new += text[at:start]
                spelled = _spelled(kind, text[start:end], rng)
                placed.append((kind, len(new), len(new) + len(spelled)))
                new, at = new + spelled, end
            out.append(_example(new + text[at:], placed))
    ids, tags = (np.stack(x) for x in zip(*out, strict=True))
    return ids, tags


def label(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with ``spans`` (kind, start, end) by the patterns, cards by their shape: labels where nobody has made others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in base_spans(t or "", shape=True)] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["text", "spans"])

    own = texts.select(F.col(text_col).alias("text"))
    return own.mapInArrow(run, "text string, spans array<struct<kind: string, start: int, end: int>>")


def sample(texts: DataFrame, most: int = 2 * MAX_WINDOWS, text_col: str = "text") -> DataFrame:
    """About ``most`` different texts with a digit or an @, drawn by hash: what is labelled and learnt from."""
    able = texts.filter(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"))
    parts = 1 << 12
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    n, taken = 0, 0
    for row in sorted(able.groupBy(part.alias("part")).count().collect()):  # a row for each of so many parts
        if n and n + row["count"] > most:
            break
        n, taken = n + row["count"], row["part"] + 1
    return able.filter(part < taken).distinct()


def fit(labelled: DataFrame, max_windows: int = MAX_WINDOWS) -> Tagger | None:
    """A tagger from labelled texts (text; spans: kind, start, end), of which ``max_windows`` windows at most are learnt from.

    Null where no window has a span.  The fit sorts what it learns from, so reruns agree in any partitioning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = [], []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                for at in window_starts(codes(text)).tolist():
                    # A span counts in the windows that hold its beginning, as far as they reach.
                    inside = [s for s in spans or () if at <= s["start"] < at + WIDE]
                    texts.append(text[at : at + WIDE])
                    places.append([{**s, "start": s["start"] - at, "end": s["end"] - at} for s in inside])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(places, kind)], ["text", "spans"])

    schema = "text string, spans array<struct<kind: string, start: int, end: int>>"
    windows = common.cut(labelled.select("text", "spans").mapInArrow(run, schema).distinct(), "pii-windows")
    n = windows.count()
    if n > max_windows:
        windows = windows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(1e6 * max_windows / n)))
    rows = [(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in KINDS]) for r in windows.collect()]
    rows.sort()
    if not any(spans for _, spans in rows):
        return None
    return train(*_examples(rows))


def _pieces(start: int, tags: np.ndarray, margin: np.ndarray, length: int) -> Iterator[tuple[int, int, int, float, bool, bool]]:
    """(kind, start, end, weight, cut at the left, cut at the right) of a window's spans in places of the text."""
    at = np.flatnonzero(tags)
    wide = min(WIDE, length - start)
    i = 0
    while i < len(at):
        j, kind = i, (tags[at[i]] - 1) // 2
        while j + 1 < len(at) and at[j + 1] == at[j] + 1 and tags[at[j + 1]] == 2 * kind + 2:
            j += 1
        first, last = int(at[i]), int(at[j]) + 1
        yield int(kind), start + first, start + min(last, wide), float(margin[first:last].sum()), first == 0 and start > 0, last >= wide and start + wide < length
        i = j + 1


def reconcile(pieces: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, weight) of the spans of one text, without overlaps, from the pieces that its windows saw."""
    whole: dict[tuple[int, int, int], float] = {}
    cut: dict[int, list[list]] = {}
    for kind, start, end, weight, left, right in sorted(pieces):
        if left or right:
            mine = cut.setdefault(kind, [])
            if mine and start <= mine[-1][1]:
                mine[-1][1:] = max(end, mine[-1][1]), max(weight, mine[-1][2])
            else:
                mine.append([start, end, weight])
        else:
            key = (kind, start, end)
            whole[key] = max(weight, whole.get(key, weight))
    # Pieces at an edge count where no window saw a span of their kind whole there.
    for kind, found in cut.items():
        seen = sorted((s, e) for k, s, e in whole if k == kind)
        starts = [s for s, _ in seen]
        for start, end, weight in found:
            i = int(np.searchsorted(starts, end)) - 1
            if not (i >= 0 and any(e > start for _, e in seen[max(0, i - 3) : i + 1])):
                whole[kind, start, end] = weight
    # The set of the largest sum of weights: by end, with or without each span.
    spans = sorted(((e, s, k, w) for (k, s, e), w in whole.items() if w > 0), key=lambda x: (x[0], x[1], x[2]))
    ends = [x[0] for x in spans]
    best: list[float] = [0.0]
    before = []
    for i, (_, start, _, weight) in enumerate(spans):
        before.append(int(np.searchsorted(ends, start, side="right")))
        before[-1] = min(before[-1], i)
        best.append(max(best[i], best[before[i]] + weight))
    out, i = [], len(spans)
    while i > 0:
        end, start, kind, weight = spans[i - 1]
        if best[i] > best[i - 1]:
            out.append((kind, start, end, weight))
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def _counted(text: str, kind: int, start: int, end: int) -> tuple[str, int, int] | None:
    """A decoded span without blanks and marks at its ends, if it fits its kind and stands alone."""
    first = "(+" if KINDS[kind] == "phone" else ""
    while start < end and not (text[start].isalnum() or text[start] in first):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    alone = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    return (KINDS[kind], start, end) if start < end and alone and fits(KINDS[kind], text[start:end]) else None


def tagged(tagger: Tagger, texts: list[str], batch: int = 512) -> list[list[tuple[int, int, int, float]]]:
    """Reconciled spans of each text; windows are decoded ``batch`` at a time."""
    pieces: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def decode() -> None:
        ids = np.full((len(waiting), WIDE), PAD, np.int64)
        for i, (_, start, code) in enumerate(waiting):
            own = code[start : start + WIDE]
            ids[i, : len(own)] = own
        tags, margin = tagger.best_tags(ids)
        for (row, start, code), t, m in zip(waiting, tags, margin, strict=True):
            pieces[row] += _pieces(start, t, m, len(code))
        waiting.clear()

    for row, text in enumerate(texts):
        code = codes(text)
        for start in window_starts(code).tolist():
            waiting.append((row, start, code))
            if len(waiting) == batch:
                decode()
    if waiting:
        decode()
    return [reconcile(p) for p in pieces]


def find(tagger: Tagger | None, texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text, by kind as in ``KINDS``, then start."""
    added = tagged(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, more in zip(texts, added, strict=True):
        base = base_spans(text)
        spans = [(*s, True) for s in base]
        taken = np.zeros(len(text) + 1, np.int32) if base and more else None
        for _, start, end in base if taken is not None else ():
            taken[start:end] = 1
        for kind, start, end, _ in more:
            found = _counted(text, kind, start, end)
            if found and (taken is None or not taken[found[1] : found[2]].any()):
                spans.append((*found, False))
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:])))
    return out


def scan(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", name: str = "_spans") -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, base) in column ``name``."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    columns, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            data, offsets = common.utf8(column)
            lit = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
            rows = np.unique(np.searchsorted(offsets, lit, side="right") - 1)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for at in range(0, len(rows), 64):
                own = rows[at : at + 64]
                texts = column.take(pa.array(own)).to_pylist()
                for row, found in zip(own.tolist(), find(shared.value, texts), strict=True):
                    spans[row] = [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPAN_TYPE)], [*columns, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` {SPANS}"])
    return docs.mapInArrow(run, schema)


def listed(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined, in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; of spans that overlap the first in place counts."""
    name = common.free(docs, "_spans")[0]
    text, start = F.col(text_col), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(a: Column, s: Column) -> Column:
        piece = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
        apart = s["start"] >= a["at"]
        return F.struct(F.when(apart, s["end"]).otherwise(a["at"]).alias("at"), F.when(apart, piece).otherwise(a["out"]).alias("out"))

    by_place = F.array_sort(F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(by_place, start, put, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return scan(docs, tagger, text_col, name).select(*(F.when(F.size(name) > 0, done).otherwise(text).alias(c) if c == text_col else F.col(c) for c in docs.columns))
