"""All that a document says of its terms, in one pass over its text: counts, first places and sources.

The rules are those of the column functions in ``functions.text`` and ``keywords``, over ASCII classes.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.functions import values as V
from lexiflow.functions.patterns import PATTERNS
from lexiflow.operators import matching

#: Sources of a term, as bits: it is counted as a token; it is a cleaned token; entity, acronym and science terms.
COUNTED, WORD, ENTITY, ACRONYM, SCIENCE = 1, 2, 4, 8, 16
SCHEMA = "doc_id long, term string, n long, first long, sources int"
KINDS = {"doc_id": pa.int64(), "term": pa.string(), "n": pa.int64(), "first": pa.int64(), "sources": pa.int32()}
#: What a worker keeps is bounded whatever the input: by ``_CACHE`` forms of tokens and runs, and ``_COUNTED`` different tokens with their
#: counts, from ``_READ`` bytes of texts at most, however long tokens are.  Texts are cut to tokens ``_PART`` bytes at a time.
_ROWS, _CACHE, _COUNTED, _SLICE = 20_000, 50_000, 75_000, 64
_PART, _READ = 1 << 18, 1 << 25
#: Repeated ids up to so many are broadcast, more are joined by shuffling.
FEW = 10_000
_DOTTED, _CAPITALS_DOTTED, _SHORT = re.compile(r"(?:[a-zA-Z]\.)+[a-zA-Z]?"), re.compile(r"(?:[A-Z]\.)+[A-Z]?"), re.compile("[A-Z]{2,6}")
#: From the first to the last of such characters.
_POINTS, _CAPITALS, _LETTERS = (re.compile(f"[{k}](?:.*[{k}])?", re.S) for k in ("A-Z.", "A-Z", "A-Za-z."))
_NO_WORD, _NO_LOWER, _SPACES = re.compile("[^a-zA-Z'-]"), re.compile("[^a-z'-]"), re.compile(f"{T.SPACE}+")
_RUN_ONLY = re.compile("[a-z0-9_]+")
_RUN_KINDS = ("suffix", "drug")
_BY_RUN = [(re.compile(p, re.A), least) for name, p, least in PATTERNS if name in _RUN_KINDS]
#: What the patterns for runs end with: few words do, and the patterns are asked about these alone.
_ENDINGS = (*V.SCIENCE_SUFFIXES, *V.DRUG_STEMS)
_BY_TEXT = [(re.compile(T.spelled(p), re.A), least) for name, p, least in PATTERNS if name not in _RUN_KINDS]


def _inner(kept: re.Pattern, raw: str) -> str:
    found = kept.search(raw)
    return found[0] if found else ""


def _dotted_form(x: str) -> str:
    x = x.lower()
    return (x[:-1] if x.endswith(".") else x) + "."


def worth(term: str, stops: frozenset[str]) -> bool:
    """Not a stop word, not of stop words alone, and with a token that says something."""
    if term in stops:
        return False
    if term.isalpha() and term.isascii() and term.islower():
        return len(term) >= 2
    parts = [(bool(_DOTTED.fullmatch(t.strip(" "))), _NO_LOWER.sub("", t.lower())) for t in _SPACES.split(term.strip(" "))]
    return any(d or (len(c) >= 2 and c not in stops) for d, c in parts) and not all(not d and c in stops for d, c in parts)


class Reader:
    """Terms of texts under one set of stop words and starters; what a token or run comes to is kept for the next text."""

    def __init__(self, stops, starters):
        self.stops, self.starters = frozenset(stops), frozenset(starters)
        self.tokens: dict[str, tuple] = {}
        # Runs that were looked at, and those of them that are science terms.
        self.runs: set[str] = set()
        self.science: set[str] = set()

    def _token(self, raw: str) -> tuple[str | None, str | None, str, str | None]:
        """(counted term, the same at a false capital, cleaned word, acronym)."""
        word = raw.lower() if raw.isalpha() and raw.isascii() else _NO_WORD.sub("", raw).lower()
        plain = word if len(word) >= 3 and word not in self.stops and word not in self.starters else None
        at_start, acronym = None, None
        if raw.islower() and "." not in raw:  # neither points nor capitals
            return self._kept(raw, (plain, None, word, None))
        if "." in raw and _DOTTED.fullmatch(dotted := _inner(_LETTERS, raw)):
            form = _dotted_form(dotted)
            plain = at_start = form if form not in self.stops else None
        if _CAPITALS_DOTTED.fullmatch(dotted := _inner(_POINTS, raw)):
            acronym = _dotted_form(dotted)
        elif _SHORT.fullmatch(short := _inner(_CAPITALS, raw)):
            acronym = short.lower()
        if acronym in self.stops:
            acronym = None
        return self._kept(raw, (plain, at_start, word, acronym))

    def _kept(self, raw: str, form: tuple) -> tuple:
        if len(self.tokens) >= _CACHE:
            self.tokens.clear()
        self.tokens[raw] = form
        return form

    def _science_runs(self, runs) -> set[str]:
        """Of the different runs of a text those that are whole ASCII words which a pattern of letters alone takes."""
        if len(self.runs) >= _CACHE:
            self.runs.clear()
            self.science.clear()
        fresh = runs.keys() - self.runs
        self.runs |= fresh
        self.science.update(run for run in fresh if run.lower().endswith(_ENDINGS) and any(len(run) >= least and p.fullmatch(run) for p, least in _BY_RUN))
        return self.science.intersection(runs)

    def read(self, paras: list[tuple[int, str]], entities, italics) -> Iterator[tuple[str, int, int | None, int]]:
        """(term, n, first, sources) of every term worth a row; counted in the whole text where tokens do not count it."""
        counts: dict[str, list[int]] = {}
        words, sources = set(), {}
        for idx, text in paras:
            tokens = matching.split(text)
            false = frozenset(matching.false_capitals(text, tokens))
            place, seen = idx << 32, {}
            for i, raw in enumerate(tokens):
                if raw in seen:
                    seen[raw][0] += 1
                else:
                    seen[raw] = [1, i]
            for raw, (n, i) in seen.items():
                plain, at_start, word, acronym = self.tokens.get(raw) or self._token(raw)
                words.add(word)
                if acronym:
                    sources[acronym] = sources.get(acronym, 0) | ACRONYM
                term = at_start if raw in false else plain
                if term is None:
                    continue
                if term in counts:
                    old = counts[term]
                    old[0] += n
                    old[1] = min(old[1], place + i)
                else:
                    counts[term] = [n, place + i]
        text = " ".join(t for _, t in paras)
        runs = matching.runs(text)
        self._science(text, runs, italics, sources)
        for term in entities or ():
            if len(term) >= 2:
                sources[term] = sources.get(term, 0) | ENTITY
        for word in words:
            if len(word) >= 2 and word not in self.stops:
                sources[word] = sources.get(word, 0) | WORD
        yield from self._rows(text, runs, counts, sources)

    def _science(self, text, runs, italics, sources) -> None:
        for run in self._science_runs(runs):
            low = run.lower()
            sources[low] = sources.get(low, 0) | SCIENCE
        for pattern, least in _BY_TEXT:
            for found in {m[0] for m in pattern.finditer(text)}:
                if len(found := found.strip(" ")) >= least:
                    low = found.lower()
                    sources[low] = sources.get(low, 0) | SCIENCE
        for term in italics or ():
            sources[term] = sources.get(term, 0) | SCIENCE

    def flags(self, paras: list[tuple[int, str]], entities, italics) -> Iterator[tuple[str, int]]:
        """(term, sources) of every word of two letters, acronym and science term, stop words too, and of entities that say something."""
        sources: dict[str, int] = {}
        for raw in {raw for _, text in paras for raw in matching.split(text)}:
            _, _, word, acronym = self.tokens.get(raw) or self._token(raw)
            if len(word) >= 2:
                sources[word] = sources.get(word, 0) | WORD
            if acronym:
                sources[acronym] = sources.get(acronym, 0) | ACRONYM
        text = " ".join(t for _, t in paras)
        self._science(text, matching.runs(text), italics, sources)
        for term in entities or ():
            if len(term) >= 2 and worth(term, self.stops):
                sources[term] = sources.get(term, 0) | ENTITY
        yield from sources.items()

    def _rows(self, text, runs, counts, sources):
        others = []
        for term, (n, first) in counts.items():
            bits = sources.get(term, 0)
            # A counted word is worth a row; a form with points is, too, unless a stop list holds it.
            yield term, n, first, bits | COUNTED
        for term, bits in sources.items():
            if term not in counts and worth(term, self.stops):
                others.append((term, bits))
        if not others:
            return
        low = text.lower()
        # Of letters that are no ASCII these two have ASCII ones in lower case.
        if "\u0130" in text or "\u212a" in text:
            lower_runs = matching.runs(low)
        else:
            lower_runs = Counter()
            for run, n in runs.items():
                lower_runs[run.lower()] += n
        mixed: dict[str, int] = dict.fromkeys((t for t, _ in others if not _RUN_ONLY.fullmatch(t)), 0)
        for _, _, term in matching.hits(low, list(mixed)):
            mixed[term] += 1
        for term, bits in others:
            yield term, (mixed[term] if term in mixed else lower_runs.get(term, 0)) or 1, None, bits


def document_terms(texts: DataFrame, entities: DataFrame | None, italics: DataFrame | None, stops, starters, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, n, first, sources) by document; rows with WORD alone are terms only where a vocabulary holds them.

    ``texts``: doc_id and paras, and maybe arrays ``entities`` and ``italics`` in the row in place of tables; rows of one document count
    as one, rows without an id as none.  ``ids``: the documents' doc_id, where a cheaper table has them.
    """
    return _read(texts, entities, italics, stops, starters, Reader.read, KINDS, SCHEMA, ids)


def document_flags(texts: DataFrame, entities: DataFrame | None, italics: DataFrame | None, stops, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, sources) by document; rows with WORD alone are terms only where a vocabulary holds them."""
    kinds = {name: KINDS[name] for name in ("doc_id", "term", "sources")}
    return _read(texts, entities, italics, stops, (), Reader.flags, kinds, "doc_id long, term string, sources int", ids)


def merged(texts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``texts`` (doc_id and arrays) with rows of one doc_id as one and none without an id.

    Repeated ids are looked for first, among ids alone; only their rows are shuffled.
    """
    texts = texts.filter("doc_id IS NOT NULL")
    again = (texts if ids is None else ids).filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    n = len(again.take(FEW + 1))
    if not n:
        return texts
    again = F.broadcast(again) if n <= FEW else again
    arrays = [F.flatten(F.collect_list(c)).alias(c) for c in texts.columns if c != "doc_id"]
    many = texts.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(*arrays)
    return texts.join(again, "doc_id", "left_anti").unionByName(many)


def _read(texts, entities, italics, stops, starters, read, kinds, schema, ids) -> DataFrame:
    rows = merged(texts, ids)
    for name, df in (("entities", entities), ("italics", italics)):
        if name in texts.columns:
            continue
        if df is None:
            rows = rows.withColumn(name, F.lit(None).cast("array<string>"))
        else:
            own = df.groupBy("doc_id").agg(F.collect_set("term").alias(name))
            rows = rows.join(own, "doc_id", "left")
    stops, starters = list(stops), list(starters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = Reader(stops, starters), []
        for batch in matching.pieces(batches, _SLICE):
            for doc, paras, names, terms in matching.read(batch):
                lines = sorted((p["para_idx"], p["text"] or "") for p in paras)
                out += ((doc, *row) for row in read(reader, lines, names, terms))
                if len(out) >= _ROWS:
                    yield matching.batch_of(out, kinds)
                    out = []
        if out:
            yield matching.batch_of(out, kinds)

    return rows.select("doc_id", "paras", "entities", "italics").mapInArrow(run, schema)


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of a text column's cleaned tokens, counted by task; a word may have several rows."""
    kinds = {"word": pa.string(), "n": pa.int64()}
    letters = b"abcdefghijklmnopqrstuvwxyz"
    lower = bytes.maketrans(letters.upper(), letters)
    kept = letters + letters.upper() + b"'-"
    dropped = bytes(b for b in range(256) if b not in kept)
    blank = re.compile(f"[{T.BLANKS[6:]}]+")  # white space beyond ASCII
    part = re.compile(rb"(?s:.{1,%d})\S*" % _PART)  # to the end of a token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Tokens are counted as they stand and cleaned once each; a task holds so many at most.
        n: Counter = Counter()

        def rows():
            words: Counter = Counter()
            while n:
                raw, k = n.popitem()
                words[raw.translate(lower, dropped)] += k
            del words[b""]
            items = ((w.decode(), k) for w, k in words.items())
            while out := list(itertools.islice(items, _ROWS)):
                yield matching.batch_of(out, kinds)

        read = 0
        for batch in batches:
            for text in batch.column(0):
                if not text.is_valid:
                    continue
                whole = text.as_py()
                whole = (whole if whole.isascii() else blank.sub(" ", whole)).encode()
                for piece in (whole,) if len(whole) <= _PART else (m[0] for m in part.finditer(whole)):
                    n.update(piece.split())
                    read += len(piece)
                    if len(n) >= _COUNTED or read >= _READ:
                        yield from rows()
                        read = 0
        yield from rows()

    return texts.mapInArrow(run, "word string, n long")
