"""URL filters (operator 3): host rules, then a weighted vocabulary by Aho-Corasick.

A rule is ``host/path``: it fits its host and all subdomains where the url's path starts with its path;
the longest fitting rule decides.  A url that no rule fits is read once by an automaton over all strict
and soft terms, the whole of it in lower case: host, path, query and fragment.  A hit counts where the term stands
between boundaries (the ends, or characters other than Unicode letters and numbers).  One strict hit blocks.  Soft
terms have weights: two or more different ones block where their weights reach ``soft_limit`` together.

Rules are a parameter of the driver's program.  The vocabulary is a list of (term, kind, weight), or a table read by
``read_vocabulary``, at most ``MAX_TERMS`` terms.  The automaton is built once, on the driver, and broadcast.

Defined results: a null url has an empty host and path and is allowed; one without ``://`` has an empty
host and path, fits no rule and is read by the automaton like any other; hosts keep ports and user names as they
stand; an empty path fits no rule; a term that is both strict and soft is strict, a soft one listed twice takes its
larger weight, an empty or null term is left out; repeated rows give repeated rows; an empty table gives no rows; extra
columns are not read by the query and kept by ``filter_urls``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Terms that an automaton holds at most: some hundred megabytes in a worker.
MAX_TERMS = 1_000_000
#: The default vocabulary: terms of gambling, adult, fraud and malware hosts in the corpus's languages.
STRICT = (
    "porn", "porno", "xxx", "hentai", "escort", "escorts", "viagra", "cialis", "casino", "kasino", "malware", "warez", "keygen",
    "camgirl", "sexcam", "putas", "nutten", "salope", "glücksspiel", "phishing",
)
SOFT = (
    ("adult", 1.0), ("sexy", 1.0), ("sex", 1.0), ("nude", 1.0), ("erotik", 1.0), ("erotic", 1.0), ("desnuda", 1.0), ("bet", 1.0),
    ("bets", 1.0), ("betting", 1.0), ("wetten", 1.0), ("apuestas", 1.0), ("poker", 1.0), ("slots", 1.0),
    ("roulette", 1.0), ("ruleta", 1.0), ("jackpot", 1.0), ("pills", 1.0), ("pharmacy", 1.0), ("torrent", 1.0), ("crack", 1.0),
    ("serial", 1.0), ("dating", 1.0), ("loan", 1.0), ("loans", 1.0), ("kredit", 1.0), ("payday", 1.0), ("cheap", 1.0), ("hot", 1.0),
    ("free", 0.5), ("gratis", 0.5), ("win", 0.5), ("bonus", 0.5), ("girls", 0.5), ("click", 0.5), ("deal", 0.5), ("now", 0.5),
)
SOFT_LIMIT = 2.0
TERMS = (*((t, "strict", 1.0) for t in STRICT), *((t, "soft", w) for t, w in SOFT))

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Rules:
    """Longest fitting rule by host suffixes: a lookup per label, however many rules there are."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            at = host.find(".", at) + 1
            if not at:
                return best


def _joins(c: str) -> bool:
    """A Unicode letter or number."""
    return c.isalnum() if c.isascii() else unicodedata.category(c)[0] in "LN"


class Vocabulary:
    """Strict and weighted soft terms in one automaton; can be sent to workers as it is."""

    def __init__(self, terms: Iterable[tuple[str, str, float]], soft_limit: float):
        import ahocorasick

        weights: dict[str, float] = {}
        for term, kind, weight in terms:
            if kind not in ("strict", "soft"):
                raise ValueError(f"{kind!r} is neither strict nor soft")
            if term:
                term = term.lower()
                weights[term] = max(weights.get(term, 0.0), float("inf") if kind == "strict" else float(weight))
        if len(weights) > MAX_TERMS:
            raise ValueError(f"{len(weights)} terms; {MAX_TERMS} is the most that is sent to workers")
        self.limit, self.empty, self.automaton = soft_limit, not weights, ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, (term, weight))
        if weights:
            self.automaton.make_automaton()

    def hits(self, text: str) -> tuple[int, int, float]:
        """(strict hits, different soft terms, their weights together)."""
        strict, soft = 0, {}
        if self.empty:
            return 0, 0, 0.0
        for end, (term, weight) in self.automaton.iter(text):
            start = end + 1 - len(term)
            if (start and _joins(text[start - 1])) or (end + 1 < len(text) and _joins(text[end + 1])):
                continue
            if weight == float("inf"):
                strict += 1
            else:
                soft[term] = weight
        return strict, len(soft), float(sum(soft[t] for t in sorted(soft)))

    def blocks(self, strict: int, soft: int, weight: float) -> bool:
        return strict > 0 or (soft >= 2 and weight >= self.limit)


def read_vocabulary(spark: SparkSession, path: str) -> list[tuple[str, str, float]]:
    """(term, kind, weight) rows of a Parquet table; more than MAX_TERMS are an error."""
    rows = spark.read.parquet(path).select("term", "kind", F.col("weight").cast("double")).head(MAX_TERMS + 1)
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return [tuple(r) for r in rows]


def _judge(table: Rules, terms: Vocabulary, host: str, path: str, whole: str) -> tuple:
    """(rule, verdict, strict hits, soft hits, soft weight); no hits are looked for where a rule decides."""
    found = table.find(host, path) if host else None
    if found:
        return (*found, 0, 0, 0.0)
    hits = terms.hits(whole.lower())
    return (None, "block" if terms.blocks(*hits) else "allow", *hits)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, terms=TERMS, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits and soft_weight (0 where a rule decides)."""
    judged = "rule string, verdict string, strict_hits int, soft_hits int, soft_weight double"
    shared = pages.sparkSession.sparkContext.broadcast((Rules(rules), Vocabulary(terms, soft_limit)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
        names = ["page_id", "host", "path", *(x.split()[0] for x in judged.split(", "))]
        for batch in batches:
            urls = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
            rows = [_judge(*shared.value, *url) for url in urls]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names)

    url = pages[url_col]
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url, F.lit("")).alias("url"))
    return rows.mapInArrow(run, f"page_id long, host string, path string, {judged}")


def filter_urls(pages: DataFrame, url_col: str = "url", rules=RULES, terms=TERMS, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """The rows of ``pages`` whose url is allowed."""
    shared = pages.sparkSession.sparkContext.broadcast((Rules(rules), Vocabulary(terms, soft_limit)))

    @F.pandas_udf("boolean")
    def allowed(hosts, paths, urls):
        import pandas as pd

        found = (_judge(*shared.value, *x)[1] == "allow" for x in zip(hosts, paths, urls, strict=True))
        return pd.Series(list(found), dtype=bool)

    url = F.col(url_col)
    return pages.filter(allowed(host_of(url), path_of(url), F.coalesce(url, F.lit(""))))
