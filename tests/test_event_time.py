"""Streams by event time against the same tables at rest."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelake.streaming.event_time import first_of, first_within, late_rows, sessions

START = datetime(2024, 1, 1)
ROW = "k string, id long, ts timestamp, kind string"


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, tmp_path, batches, make):
    given, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(ROW).parquet(given)
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "marks")).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
        yield query
    run.found = spark.read.parquet(out)


def test_first_results_and_late_rows(spark, tmp_path):
    batches = [
        [("a", 1, at(0), "ask"), ("a", 2, at(5), "tell"), ("a", 3, at(6), "tell"), ("b", 4, at(1), "ask")],
        [("b", 5, at(20), "tell"), ("b", 6, at(90), "tell"), ("a", 7, at(100), "ask")],
        [("a", 8, at(4), "tell"), ("a", 9, at(104), "tell")],  # 8 is later than the watermark allows
        [("z", 10, at(10_000), "ask"), ("z", 11, at(10_000), "tell")],
        [("z", 12, at(20_000), "ask"), ("z", 13, at(20_000), "tell")],
    ]
    side = lambda df, kind: df.where(F.col("kind") == kind)
    make = lambda s: first_within(side(s, "ask"), side(s, "tell"), "k", "ts", "id", "30 minutes", late="10 minutes")
    dropped = sum(late_rows(q) for q in run(spark, tmp_path, batches, make))
    assert sorted((r.k, r.id, r.result) for r in first_of(run.found, "k", "ts", "id").collect()) == [("a", 1, 2), ("a", 7, 9), ("b", 4, 5)]
    assert dropped >= 1
    rest = spark.createDataFrame([x for i, b in enumerate(batches) for x in b if x[1] != 8], ROW)
    table = first_of(first_within(side(rest, "ask"), side(rest, "tell"), "k", "ts", "id", "30 minutes"), "k", "ts", "id")
    assert sorted((r.k, r.id, r.result) for r in table.collect()) == [("a", 1, 2), ("a", 7, 9), ("b", 4, 5)]


def test_sessions(spark, tmp_path):
    batches = [[("a", 1, at(0), ""), ("a", 2, at(9), ""), ("b", 3, at(3), "")], [("a", 4, at(30), ""), ("a", 5, at(18), "")], [("z", 6, at(9000), "")], [("z", 7, at(99_000), "")]]
    for _ in run(spark, tmp_path, batches, lambda s: sessions(s, "k", "ts", "10 minutes", late="40 minutes")):
        pass
    got = sorted((r.k, r.start, r.end, r.n) for r in run.found.collect())
    whole = sessions(spark.createDataFrame([x for b in batches for x in b], ROW), "k", "ts", "10 minutes")
    assert [x for x in got if x[0] != "z"] == sorted((r.k, r.start, r.end, r.n) for r in whole.collect() if r.k != "z") and len(got) >= 3
