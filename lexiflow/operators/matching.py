"""Many terms in one text at once: Aho-Corasick passes, a text at a time, linear in the text and the hits.

A hit counts between ASCII word boundaries, as ``\\bterm\\b`` does in an engine whose ``\\b`` is ASCII: a
boundary lies where one of two neighbouring characters is a letter, digit or underscore and the other is not.  Hits of one
term do not overlap, the leftmost first.  Terms and lower-case texts are compared as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from string import ascii_letters, digits

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T

_WORD = frozenset(ascii_letters + digits + "_")
_SPACES, _BLANK = re.compile(f"{T.SPACE}+"), re.compile(T.SPACE)
#: What ``str.split`` takes for white space beside these, or does not.
_OTHER_SPACES = re.compile("[\x1c-\x1f\x85\ufeff]")
_CAPITALS = re.compile("[A-Z]+")
_RUN, _CAPITAL_RUN = re.compile("[A-Za-z0-9_]+"), re.compile(r"\b[A-Z]\w*", re.A)
_GLUE = re.compile(rf"[^\w{T.BLANKS}](?=\w)", re.A)
_TO_RUNS = bytes(b if chr(b) in _WORD else 32 for b in range(256))
_LONG, _SLICE = 64, 256

TEXTS = "doc_id long, paras array<struct<para_idx: long, text: string>>"


def _automaton(terms):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in terms:
        out.add_word(term, term)
    out.make_automaton()
    return out


def split(text: str) -> list[str]:
    """Tokens between white space; none empty."""
    return [t for t in _SPACES.split(text) if t] if _OTHER_SPACES.search(text) else text.split()


def _run_bytes(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO_RUNS).split()


def runs(text: str) -> Counter:
    """Counted runs of ASCII letters, digits and underscores, which are the hits of terms of such characters alone."""
    return Counter({run.decode(): n for run, n in Counter(_run_bytes(text)).items()})


def _edge(text: str, at: int) -> bool:
    before = at > 0 and text[at - 1] in _WORD
    return before != (at < len(text) and text[at] in _WORD)


def hits(text: str, terms: list[str]) -> Iterator[tuple[int, int, str]]:
    """(start, end, term) of every hit, by end."""
    if not terms or not text:
        return
    past = dict.fromkeys(terms, 0)
    for last, term in _automaton(terms).iter(text):
        end = last + 1
        start = end - len(term)
        if start >= past[term] and _edge(text, start) and _edge(text, end):
            past[term] = end
            yield start, end, term


def read(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns), strict=True)


def pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to ``size`` rows, so that few texts and terms are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def top_terms(texts: DataFrame, scored: DataFrame, percent: float = 50) -> DataFrame:
    """(doc_id, para_idx, term, score, rank): each paragraph's best terms, the top ``percent`` of those it holds, one at least.

    ``scored``: doc_id, term, score and rank in the document, which decides ties.
    """
    kinds = {"doc_id": pa.int64(), "para_idx": pa.int64(), "term": pa.string(), "score": pa.float64(), "rank": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, _SLICE):
            rows = []
            for doc, places, whole, terms, scores, ranks in read(batch):
                lows = [(text or "").lower() for text in whole]
                order = {term: (-score, rank) for term, score, rank in zip(terms, scores, ranks, strict=True)}
                for place, best in zip(places, best_terms(lows, order, percent), strict=True):
                    rows += ((doc, place, term, -order[term][0], i) for i, term in enumerate(best, 1))
            yield batch_of(rows, kinds)

    places = F.transform("paras", lambda p: p["para_idx"])
    lines = F.transform("paras", lambda p: p["text"])
    rows = with_terms(texts.select("doc_id", places.alias("places"), lines.alias("lines")), scored)
    return rows.mapInArrow(run, "doc_id long, para_idx long, term string, score double, rank long")


def with_terms(rows: DataFrame, scored: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` of documents that have scored terms, with these as arrays ``terms``, ``scores`` and ``ranks`` behind their columns."""
    own = scored.groupBy("doc_id").agg(F.collect_list(F.struct("term", "score", "rank")).alias("terms"))
    own = own.select("doc_id", *(F.col(f"terms.{c}").alias(f"{c}s") for c in ("term", "score", "rank")))
    return rows.join(own, "doc_id", how).select(*rows.columns, "terms", "scores", "ranks")


def best_terms(lows: list[str], order: dict, percent: float) -> Iterator[list[str]]:
    """Each text's best terms by ``order``, the top ``percent`` of those it holds, one at least."""
    for low, met in zip(lows, _met(lows, list(order)), strict=True):
        best = sorted(met, key=order.__getitem__) if low else []
        yield best[: max(1, math.ceil(len(best) * (percent / 100)))]


def _met(texts: list[str], terms: list[str]) -> Iterator[set[str]]:
    """The terms that each text holds: whole runs by look-up, the others by the automaton."""
    whole = {t.encode(): t for t in terms if _RUN.fullmatch(t)}
    mixed = [t for t in terms if not _RUN.fullmatch(t)]
    found = _automaton(mixed) if mixed else None
    for text in texts:
        met = {whole[run] for run in whole.keys() & set(_run_bytes(text))}
        for last, term in found.iter(text) if found and text else ():
            if term not in met and _edge(text, last + 1 - len(term)) and _edge(text, last + 1):
                met.add(term)
        yield met


def false_capitals(text: str, tokens: list[str] | None = None) -> list[str]:
    """The different tokens that are capitalised, not all capitals, and only ever stand at the start of a sentence.

    ``tokens``: those of ``split``, where they are at hand.
    """
    tokens = split(text) if tokens is None else tokens
    opens, openers = not _BLANK.match(text), Counter()
    for token in tokens:
        if opens and "A" <= token[0] <= "Z":
            openers[token] += 1
        opens = token[-1] in ".!?"
    if not openers:
        return []
    # Such a token, or a longer one that it begins, opens a sentence.
    known, opened, lengths = set(tokens), Counter(), None
    for token, n in openers.items():
        if len(token) > _LONG and lengths is None:
            lengths = {len(t) for t in known}
        for k in range(1, len(token) + 1) if len(token) <= _LONG else (k for k in lengths if k <= len(token)):
            if (head := token[:k]) in known:
                opened[head] += n
    words = [w for w in opened if not _CAPITALS.fullmatch(w)]
    mixed = [w for w in words if not _RUN.fullmatch(w)]
    everywhere = Counter(_CAPITAL_RUN.findall(text)) if len(mixed) < len(words) else {}
    out = [w for w in words if _RUN.fullmatch(w) and opened[w] == everywhere[w]]
    # One that ends in a mark has no boundary behind it, unless a word follows that mark somewhere.
    if any(w[-1] not in _WORD for w in mixed):
        glue = frozenset(_GLUE.findall(text))
        mixed = [w for w in mixed if w[-1] in _WORD or w[-1] in glue]
    return sorted(out + _false_mixed(text, mixed)) if mixed else sorted(out)


def _false_mixed(text: str, words: list[str]) -> list[str]:
    """The same of any words, by one pass of an automaton."""
    opened, everywhere = dict.fromkeys(words, 0), dict.fromkeys(words, 0)
    open_past, past = dict.fromkeys(words, 0), dict.fromkeys(words, 0)
    for last, word in _automaton(words).iter(text):
        end = last + 1
        start = end - len(word)
        if start >= past[word] and _edge(text, start) and _edge(text, end):
            everywhere[word] += 1
            past[word] = end
        mark = start - 1
        while mark >= 0 and _BLANK.match(text[mark]):
            mark -= 1
        opens = start == 0 or (0 <= mark < start - 1 and text[mark] in ".!?")
        # A match begins at the mark, which a match before must not have taken.
        if opens and max(mark, 0) >= open_past[word]:
            opened[word] += 1
            open_past[word] = end
    return [w for w in words if opened[w] and opened[w] == everywhere[w]]


def with_false_capitals(paras: DataFrame, name: str = "_false") -> DataFrame:
    """``paras`` (doc_id, para_idx, text) with each paragraph's false capitals."""
    kinds = {"doc_id": pa.int64(), "para_idx": pa.int64(), "text": pa.string(), name: pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [false_capitals(text) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kinds[name])], list(kinds))

    schema = f"doc_id long, para_idx long, text string, `{name}` array<string>"
    return paras.select(F.col("doc_id").cast("long"), F.col("para_idx").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
