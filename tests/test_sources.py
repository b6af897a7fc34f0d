"""The data source of logs and the segmentation of streams against the segmentation of whole logs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.sources import trace, trace_source
from tracelake.streaming.segments import _in_order, streamed_segments

COLUMNS = ("trace_id", "entry_id", "line_number", "tag", "function", "source_file", "source_line", "body")
HEAD, FOOT = "-" * 8 + " [{}] fn src/é.cpp:{} " + "-" * 9, "-" * 48


def log(seed, n=60):
    r = random.Random(seed)
    return [r.choice([HEAD.format(r.choice("ab"), i), HEAD.format("c", i) + "  ", "body é " * r.randint(0, 9), "", FOOT, FOOT, FOOT + "  ", "-" * 47, "-" * 49]) for i in range(n)]


def rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def written(tmp_path, ends=("\n", "", "\r\n")):
    for i, last in enumerate(ends):
        lines = log(i)
        newline = "\r\n" if last == "\r\n" else "\n"
        (tmp_path / f"{i}.log").write_bytes((newline.join(lines) + last).encode())
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "closed.log").write_text(HEAD.format("a", 1) + "\nx\n" + FOOT)
    (tmp_path / "_hidden").write_text("no log")
    return str(tmp_path)


@pytest.mark.parametrize("block", [61, 333, 1 << 20])
def test_ranges_of_any_size_give_the_entries(spark, tmp_path, block):
    path = written(tmp_path)
    want = rows(trace.segment(trace.lines_of(spark, path + "/*.log")))
    assert rows(trace_source.read_trace(spark, path, block)) == want and want
    assert rows(trace_source.read_trace(spark, path + "/0.log", block)) == [r for r in want if r[0].endswith("/0.log")]


def test_a_growing_log_streams_its_blocks(spark, tmp_path):
    logs, out, marks = tmp_path / "logs", tmp_path / "out", tmp_path / "marks"
    logs.mkdir()
    text = "\n".join(log(5, 200)) + "\n"
    for upto in (0.3, 0.301, 0.7, 1):
        (logs / "a.log").write_text(text[: int(len(text) * upto)])
        stream = trace_source.stream_trace(spark, str(logs), 100)
        stream.writeStream.format("parquet").option("checkpointLocation", str(marks)).trigger(availableNow=True).start(str(out)).awaitTermination()
    want = [r[3:] for r in rows(trace.segment(trace.lines_of(spark, str(logs))))]
    assert [tuple(r[c] for c in COLUMNS[3:]) for r in spark.read.parquet(str(out)).orderBy("end_at").collect()] == sorted(want, key=lambda r: r[3])


@pytest.fixture
def stateful(spark):
    """RocksDB states, and no batches without data: processing-time timers would ask for them for ever."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name in settings:
        spark.conf.unset(name)


@pytest.mark.parametrize("cuts", [(1,), (2, 5, 40, 41), (9, 18, 50)])
def test_segments_of_a_stream_for_any_cut(stateful, tmp_path, cuts):
    spark = stateful
    lines = [(f"t{t}", i + 1, x) for t in range(3) for i, x in enumerate(log(t + 20, 90))]
    schema = "trace_id string, line_number long, line string"
    given, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    for a, b in zip((0, *cuts), (*cuts, 1000), strict=True):
        part = [x for x in lines if a < x[1] <= b]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(given)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(given)
            streamed_segments(stream).writeStream.format("parquet").option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    want = rows(trace.segment(spark.createDataFrame(lines, schema)))
    assert rows(spark.read.parquet(out)) == want and want


def test_a_silent_log_is_forgotten(stateful, tmp_path):
    spark = stateful
    schema = "trace_id string, line_number long, line string"
    given, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))

    def step(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(schema).parquet(given)
        query = streamed_segments(stream, 1).writeStream.format("parquet").option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
        return query.lastProgress

    step([("dead", 1, HEAD.format("a", 1)), ("dead", 2, "x")])
    progress = step([("live", 1, HEAD.format("a", 1)), ("live", 2, FOOT)])
    step([("dead", 3, FOOT), ("live", 3, "y")])
    assert [r["trace_id"] for r in spark.read.parquet(out).collect()] == ["live"] and progress is not None


def test_lines_of_a_micro_batch_in_order_by_spans():
    """Beyond a span of lines only one span is held; the order is that of the numbers."""
    numbers = random.Random(7).sample(range(1, 5000), 3000)
    parts = lambda n: (pd.DataFrame([(i, f"line {i}") for i in numbers[at : at + n]], columns=["line_number", "line"]) for at in range(0, len(numbers), n))
    for n, span in ((100, 64), (3000, 500), (7, 10_000), (1, 1)):
        assert list(_in_order(parts(n), span)) == [(i, f"line {i}") for i in sorted(numbers)]
    assert list(_in_order(iter([]), 64)) == []
