"""Block-structured logs: reading lines, and cutting them into entries without a state machine."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.core import running_total, total_before

# Fixed values of the log format: 8 dashes, [tag], function, path:line, 9 dashes; 48 dashes close a block.
HEADER = r"^-{8} \[([^\]]+)\] (\S+) (.+):(\d+)\s*-{9}\s*$"
FOOTER = r"^-{48}$"


def lines_of(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """trace_id, line_number, line of the files at a path.

    Each block of a file numbers its own lines, and the blocks' counts are put before one another, so a
    file of any size is read by many tasks. ``whole``: a file is one row, for many small ones.
    """
    if whole:
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("trace_id"), "value")
        parts = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
        return text.select("trace_id", F.posexplode(parts).alias("at", "line")).select("trace_id", (F.col("at") + 1).cast("long").alias("line_number"), "line")
    block = F.col("_metadata.file_block_start").alias("_block")
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("trace_id"), block, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    before = Window.partitionBy("trace_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = text.groupBy("trace_id", "_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select("trace_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("trace_id", "_block").orderBy("_id"))
    return text.withColumn("_in", inside).join(blocks, ["trace_id", "_block"]).select("trace_id", (F.col("_before") + F.col("_in")).alias("line_number"), "line")


def lines_from(spark: SparkSession, stream: Iterable[str], name: str = "stream", lot: int = 100_000) -> DataFrame:
    """The lines of an open text stream or any iterable of lines, handed over in lots."""
    schema = "trace_id string, line_number long, line string"
    out, at, rows = spark.createDataFrame([], schema), 0, iter(stream)
    while some := list(islice(rows, lot)):
        out = out.unionByName(spark.createDataFrame([(name, at + i + 1, x.rstrip("\r\n")) for i, x in enumerate(some)], schema))
        at += len(some)
    return out


def labelled_lines(spark: SparkSession, labelled: list[tuple[str, str]], whole: bool = False) -> DataFrame:
    """The lines of many logs with the label of each; a label may have several."""
    parts = [lines_of(spark, path, whole).withColumn("label", F.lit(label)) for label, path in labelled]
    return reduce(DataFrame.unionByName, parts)


def segment(lines: DataFrame) -> DataFrame:
    """Entries (trace_id, entry_id, line_number, tag, function, source_file, source_line, body) of log lines.

    A footer ends whatever is open, so between two footers only the first header can open a block;
    a later header-like line is body, and a block without a footer is dropped. So the number of
    footers before a line, a running total that is dealt over tasks, replaces the scanner's state, and
    a block's lines are what one task holds.
    """
    marked = lines.select("trace_id", "line_number", "line", F.rtrim("line").rlike(FOOTER).alias("_ft"), F.col("line").rlike(HEADER).alias("_hd"))
    seg = running_total(marked, "trace_id", "line_number", F.col("_ft").cast("int"), "_seg")
    block = Window.partitionBy("trace_id", "_seg")
    seg = seg.withColumn("_start", F.min(F.when(F.col("_hd") & ~F.col("_ft"), F.col("line_number"))).over(block)).withColumn("_closed", F.max(F.col("_ft").cast("int")).over(block))
    inside = seg.where("line_number >= _start and _closed = 1 and not _ft")
    rows = inside.groupBy("trace_id", "_seg").agg(F.first("_start").alias("line_number"), F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("_l"))
    head = F.col("_l")[0]["line"]
    body = F.transform(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), lambda x: x["line"])
    part = lambda i: F.regexp_extract(head, HEADER, i)
    rows = running_total(rows, "trace_id", "_seg", F.lit(1), "_n")
    return rows.select(
        "trace_id", (F.col("_n") + 1).alias("entry_id"), "line_number", part(1).alias("tag"), part(2).alias("function"),
        part(3).alias("source_file"), part(4).cast("int").alias("source_line"), body.alias("body"),
    )


def rendered(rows: DataFrame, order, tag: Column, function: Column, body: Column, trace: Column | None = None) -> DataFrame:
    """Log lines of any table: a block per row, ``body`` (array of lines) inside. The inverse of ``segment``.

    By one column of whole numbers, a log is numbered in spans; by other orders a log is one task's.
    """
    order = [order] if isinstance(order, str) else list(order)
    header = F.concat(F.lit("-" * 8 + " ["), tag, F.lit("] "), function, F.lit(" table.row:1 " + "-" * 9))
    block = F.concat(F.array(header), body, F.array(F.lit("-" * 48)))
    shown = rows.select((trace if trace is not None else F.lit("trace")).alias("trace_id"), *order, block.alias("_b"))
    shown = total_before(shown, ["trace_id"], order, F.size("_b"), "_at")
    return shown.select("trace_id", "_at", F.posexplode("_b").alias("_i", "line")).select("trace_id", (F.col("_at") + F.col("_i") + 1).cast("long").alias("line_number"), "line")


def body_text(body: str = "body") -> Column:
    return F.array_join(body, "\n")
