"""Streams give what the batch operators give, once, and go on where they stopped."""

import datetime

from pyspark.sql import functions as F

from lexiflow.functions import scores as S
from lexiflow.sources import tables as B
from lexiflow.streaming import documents as D
from lexiflow.streaming import sessions

TEXT = "Simple words are here. They are short.\nExtraordinarily complicated institutional characterisations necessitate considerable interpretation."


def _write(spark, path, ids, minute):
    time = datetime.datetime(2024, 1, 1, 0, minute)
    spark.createDataFrame([(i, TEXT if i % 2 else None, "en", time) for i in ids], "doc_id long, text string, lang string, time timestamp").write.mode("append").parquet(path)


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    schema = "doc_id long, text string, lang string, time timestamp"
    for ids in (range(0, 5), range(5, 9)):
        _write(spark, src, ids, 1)
        stream = S.paragraph_scores(B.paragraphs(D.read_documents(spark, src, schema)))
        D.write(stream, out, mark).awaitTermination()
    batch = S.paragraph_scores(B.paragraphs(spark.read.parquet(src)))
    rows = lambda df: sorted(str(r) for r in df.select(*batch.columns).collect())
    assert rows(spark.read.parquet(out)) == rows(batch) and batch.count() > 0


def test_windows_close_at_the_watermark(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    schema = "doc_id long, text string, lang string, time timestamp"
    for ids, minute in ((range(1, 4), 1), (range(4, 6), 55), (range(6, 8), 56), (range(8, 10), 2)):  # the last come too late
        _write(spark, src, ids, minute)
        D.write(D.action_counts(D.read_documents(spark, src, schema), "time"), out, mark).awaitTermination()
    found = spark.read.parquet(out).groupBy(F.minute("window.start").alias("m")).agg(F.sum("n").alias("n")).collect()
    assert {r.m: r.n for r in found} == {0: 4}


def test_debounced_stream_equals_batch(spark, tmp_path):
    """Runs merge across batches, also where a late event joins two of them."""
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    schema = "event_id long, ts timestamp, user_id long, kind string"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)
    batches = [[(1, at(0), 1, "a"), (2, at(4), 1, "b"), (3, at(3), 2, "x")], [(4, at(12), 1, "c"), (5, at(4), 2, "y"), (6, at(4), 2, "z")], [(7, at(8), 1, "d"), (8, None, 1, "e")], [(9, at(59), 3, "end")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = sessions.debounced(D.read_documents(spark, src, schema), "5 minutes", ["user_id"], ["event_id", "kind"], late="10 minutes")
        D.write(stream, out, mark).awaitTermination()
    batch = sessions.debounced(spark.read.parquet(src), "5 minutes", ["user_id"], ["event_id", "kind"])
    assert sorted((r.user_id, r.n, r.event_id, r.kind) for r in batch.collect()) == [(1, 4, 4, "c"), (2, 3, 6, "z"), (3, 1, 9, "end")]
    rows = lambda df: sorted(str(r) for r in df.filter("user_id < 3").select(*batch.columns).collect())
    assert rows(spark.read.parquet(out)) == rows(batch)
