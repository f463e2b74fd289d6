"""Names by evidence from the corpus: words that are capitalised where nothing asks for it, and neighbours that keep together.

A word counts as one of names if it is capitalised in at least half of its places inside sentences, where a sentence's beginning explains
nothing; words all in capitals give no evidence and are no names.  Two neighbours belong to one name if the pair is no accident of two frequent
words: it makes up at least one in ``TOGETHER`` of the capitalised places of the rarer one.  A name is a run of such words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T

TOGETHER, LEAST = 20, 2


def _tokens(sentences: DataFrame) -> DataFrame:
    """(doc_id, para_idx, sent_idx, _t, _w): tokens, and the same without marks at their ends, by passes over whole sentences."""
    line = F.regexp_replace("sentence", f"{T.JAVA_SPACE}+", " ")
    # Marks at either end of a token, looked at from their first one alone.
    bare = F.regexp_replace(line, "(?=[^A-Za-z ])(?<![^A-Za-z ])(?:(?<![^ ])[^A-Za-z ]++|[^A-Za-z ]++(?![^ ]))", "")
    return sentences.select("doc_id", "para_idx", "sent_idx", F.split(line, " ", -1).alias("_t"), F.split(bare, " ", -1).alias("_w"))


def _capital(w):
    return w.rlike("^[A-Z][a-z]")


def _capitals(sentences: DataFrame) -> DataFrame:
    """(doc_id, para_idx, sent_idx, i, word, before): capitalised tokens; ``before`` is the capitalised word that stands before one
    without a mark between."""

    def token(w, i):
        last, before = F.get("_t", i - 1), F.get("_w", i - 1)
        joined = (i > 0) & _capital(before) & last.rlike("[A-Za-z]$") & F.get("_t", i).rlike("^[A-Za-z]")
        return F.when(_capital(w), F.struct(i.alias("i"), F.lower(w).alias("word"), F.when(joined, F.lower(before)).alias("before")))

    found = F.filter(F.transform("_w", token), lambda x: x.isNotNull())
    return _tokens(sentences).select("doc_id", "para_idx", "sent_idx", F.explode(found).alias("x")).select("doc_id", "para_idx", "sent_idx", "x.*")


def name_words(sentences: DataFrame) -> DataFrame:
    """(word, n_inside, n_capital, n_seen): words of names with their places inside sentences, those capitalised, and all capitalised ones.

    Words are counted as they stand and looked at once each.
    """
    each = _tokens(sentences).select(F.posexplode("_w").alias("i", "w")).filter("w <> ''").groupBy("w", (F.col("i") > 0).alias("inside")).agg(F.count("*").alias("n"))
    rows = each.select(F.lower("w").alias("word"), "inside", _capital(F.col("w")).alias("capital"), "n")
    sum_of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    inside, capital = F.col("inside"), F.col("capital")
    n = rows.groupBy("word").agg(sum_of(inside).alias("n_inside"), sum_of(inside & capital).alias("n_capital"), sum_of(capital).alias("n_seen"))
    return n.filter("n_capital > 0 AND 2 * n_capital >= n_inside")


def names(sentences: DataFrame) -> DataFrame:
    """(doc_id, term, n): names of two words or more, in lower case, with their places.

    ``sentences``: doc_id, para_idx, sent_idx, sentence.
    """
    known = name_words(sentences)
    seen = _capitals(sentences)
    pairs = seen.filter("before IS NOT NULL").groupBy("before", "word").agg(F.count("*").alias("n"))
    pairs = pairs.join(known.select("word", F.col("n_seen").alias("_b")), "word").join(known.select(F.col("word").alias("before"), F.col("n_seen").alias("_a")), "before")
    pairs = pairs.filter(F.lit(TOGETHER) * F.col("n") >= F.least("_a", "_b")).select("before", "word", F.lit(True).alias("_together"))
    # Both words of such a pair are words of names; a run goes on through pairs alone.
    found = seen.join(pairs, ["before", "word"], "left").select("doc_id", "para_idx", "sent_idx", "i", "word", "before", F.col("_together").isNotNull().alias("on"))
    place = Window.partitionBy("doc_id", "para_idx", "sent_idx").orderBy("i")
    starts = found.withColumn("run", F.sum((~F.col("on")).cast("int")).over(place))
    runs = starts.groupBy("doc_id", "para_idx", "sent_idx", "run").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    long_ = runs.filter(F.size("w") >= LEAST).select("doc_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("term"))
    return long_.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
