"""Readers of run results: sweep tables, statistics files, plans; and text sinks."""

from __future__ import annotations

import glob
import os
import shlex
import tempfile
import uuid
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("config", "seed", "status", "time_s")
PLAN = (
    "version int, source string, source_abs string, split_predicates array<struct<name string, score double, reduces_to_false_on string, probe_ms map<string,double>>>, "
    "leaves array<struct<valuation map<string,boolean>, file string, pruned boolean, reason string>>, results string, implied_units map<string,boolean>, _corrupt string"
)


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the one that all executors share (unset, in one process: a temporary one)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
    return f"{(at or tempfile.gettempdir()).rstrip('/')}/tracelake/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table below the shared folder and read back: made once however often it is used, and without lineage."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def run_stream(spark: SparkSession, rows: DataFrame, at: str, settings: dict[str, str]) -> None:
    """All that a stream has now, written as a table at ``at``; the session's settings are as before."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{at}-marks").outputMode("append").trigger(availableNow=True)
        writer.start(at).awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a sweep table; a blank split is none; missing columns are an error."""
    df = spark.read.csv(path, header=True)
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    split = F.nullif(F.col("split"), F.lit("")) if "split" in df.columns else F.lit(None).cast("string")
    return df.select(split.alias("split"), "config", F.col("seed").try_cast("int").alias("seed"), "status", F.col("time_s").try_cast("double").alias("time_s"))


def stats_of(text: Column) -> Column:
    """The statistics of the trailing "(:key value ...)" block as a map of strings; null without one."""
    tail = F.regexp_extract(text, r"\(\s*(:[\s\S]+?)\)\s*\z", 1)
    keys, values = (F.regexp_extract_all(tail, F.lit(r":([\w\-.]+)\s+(\S+)"), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    # A repeated key keeps its last value.
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(keys, p["i"] + 2, F.size(keys)), lambda k: k == p["k"]))
    return F.when(F.size(keys) > 0, F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"]))))


def result_of(text: Column) -> Column:
    """The last result line before the statistics."""
    head = F.regexp_replace(text, r"\(\s*:[\s\S]+?\)\s*\z", "")
    return F.try_element_at(F.regexp_extract_all(head, F.lit(r"(?m)^(sat|unsat|unknown)\s*$"), F.lit(1)), F.lit(-1))


def _numbers(df: DataFrame, stats: Column, *keep: str) -> DataFrame:
    text = F.lower("text")
    value = F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.col("text").try_cast("double"))
    return df.select(*keep, F.explode(stats).alias("key", "text")).select(*keep, "key", value.alias("value")).where("value is not null")


def read_stats_dir(spark: SparkSession, path: str) -> DataFrame:
    """config, seed, key, value of every <config>_s<seed>.stats.json; what can't be read is skipped."""
    name = F.col("_metadata.file_name")
    pattern = r"^(.+)_s(\d+)\.stats\.json$"
    files = spark.read.option("pathGlobFilter", "*.stats.json").text(path, wholetext=True).where(name.rlike(pattern))
    files = files.select(F.regexp_extract(name, pattern, 1).alias("config"), F.regexp_extract(name, pattern, 2).cast("int").alias("seed"), F.from_json("value", "map<string,string>").alias("stats"))
    return _numbers(files, F.col("stats"), "config", "seed")


def read_stats_files(spark: SparkSession, labelled: list[tuple[str, str]]) -> DataFrame:
    """label, path, result, stats of raw outputs; those without either are skipped."""
    names = spark.createDataFrame([(a, PurePosixPath(p).as_posix()) for a, p in labelled], "label string, path string")
    text = spark.read.text([p for _, p in labelled], wholetext=True).select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), "value")
    out = text.join(F.broadcast(names), "path").select("label", "path", result_of(F.col("value")).alias("result"), stats_of(F.col("value")).alias("stats"))
    return out.where("result is not null or stats is not null")


def seed_counts(runs: DataFrame, seed: str | None = "seed") -> DataFrame:
    """Per config its number of different seeds, or (``seed`` None: a row per file) of files with statistics."""
    n = F.countDistinct(seed) if seed else F.count_if(F.col("stats").isNotNull())
    return runs.groupBy("config").agg(n.alias("seeds"))


def result_summary(files: DataFrame, order: str = "path") -> DataFrame:
    """Per label its files' results: the one they share, else each with its number, most first (then by ``order``); none is a dash."""
    per = files.groupBy("label", "result").agg(F.count("*").alias("n"), F.min(order).alias("f")).where("result is not null")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "f", "result", "n")))
    text = F.when(F.size(listed) == 1, listed[0]["result"]).otherwise(F.array_join(F.transform(listed, lambda x: F.concat(x["result"], F.lit("("), x["n"].cast("string"), F.lit(")"))), " "))
    found = per.groupBy("label").agg(text.alias("results"))
    return files.select("label").distinct().join(found, "label", "left").na.fill("—", ["results"])


def stats_long(files: DataFrame) -> DataFrame:
    return _numbers(files.withColumnRenamed("label", "config"), F.col("stats"), "config", "path")


def label_paths(specs: list[str]) -> list[tuple[str, str]]:
    """NAME=GLOB and plain paths (labelled by their stems) as (label, path); a folder or a pattern that finds nothing is an error."""
    out = []
    for spec in specs:
        label, eq, where = spec.partition("=")
        if eq and not label:
            raise ValueError(f"empty name in {spec!r}")
        found = sorted(glob.glob(where if eq else spec))
        if not found:
            raise ValueError(f"no file matches {spec!r}")
        if folders := [p for p in found if os.path.isdir(p)]:
            raise ValueError(f"files and folders can't be mixed: {folders[0]}")
        out += [(label if eq else PurePosixPath(p).stem, p) for p in found]
    return out


def read_plans(spark: SparkSession, root: str, most: int = 1) -> DataFrame:
    """Every plan.json below ``root`` with its path and depth; what isn't a plan is skipped, a missing version is the supported one, a later one an error."""
    path = F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "plan.json").text(root, wholetext=True).select("value", path)
    plans = text.select("path", F.from_json("value", PLAN, {"columnNameOfCorruptRecord": "_corrupt"}).alias("p")).select("path", "p.*").where("_corrupt is null").drop("_corrupt")
    plans = plans.withColumn("version", F.coalesce("version", F.lit(most)))
    if not plans.where(F.col("version") > most).isEmpty():
        raise ValueError(f"a plan's version is above {most}")
    below = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(plans.schema[c].dataType)).alias(c)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("source", "source_abs")]
    empty = F.coalesce("implied_units", F.create_map().cast("map<string,boolean>")).alias("implied_units")
    return plans.select("version", *text, none("split_predicates"), none("leaves"), "results", empty, "path", (F.size(F.split(below, "/")) - 1).alias("depth"))


def plan_totals(plans: DataFrame) -> DataFrame:
    """leaves, emitted, pruned, max_depth, with_results over a tree of plans."""
    pruned = F.size(F.filter("leaves", lambda x: F.coalesce(x["pruned"], F.lit(False))))
    return plans.agg(F.sum(F.size("leaves")).alias("leaves"), F.sum(F.size("leaves") - pruned).alias("emitted"), F.sum(pruned).alias("pruned"), F.max("depth").alias("max_depth"), F.count_if(F.col("results").isNotNull()).alias("with_results"))


def leaf_children(plans: DataFrame) -> DataFrame:
    """Leaves that were split on: <stem>_children/plan.json exists."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    leaves = plans.select(folder(F.col("path")).alias("folder"), F.explode("leaves").alias("leaf")).where("leaf.file is not null")
    leaves = leaves.withColumn("child", F.concat("folder", F.lit("/"), F.regexp_replace("leaf.file", r"\.[^.]*$", ""), F.lit("_children/plan.json")))
    return leaves.join(plans.select(F.col("path").alias("child")), "child", "left_semi")


# -- specifications, on the driver -----------------------------------------------------------
def seeds(spec: str) -> list[int]:
    """0-3,7 as [0, 1, 2, 3, 7]; repeats stay."""
    out: list[int] = []
    for part in spec.split(","):
        low, dash, high = part.strip().partition("-")
        out += range(int(low), int(high) + 1) if dash else [int(low)]
    return out


def index_ranges(spec: str, total: int) -> list[int]:
    """3,5:10,2-4,:5,12: as distinct indices from 1, in order; ranges end at ``total``, and one that starts beyond it is that index alone."""
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, sep, high = part.partition(":" if ":" in part else "-")
        a = int(low) if low else 1
        b = min(int(high), total) if high else total if sep else a
        if sep and high and int(high) < a:
            raise ValueError(f"reversed range {part!r}")
        out.update(dict.fromkeys(range(a, max(a, b) + 1)))
    return list(out)


def config(spec: str) -> tuple[str, dict[str, str]]:
    """name: key=value ... with shell quoting."""
    name, _, rest = spec.partition(":")
    pairs = [p.partition("=") for p in shlex.split(rest)]
    if bad := [k for k, eq, _ in pairs if not eq]:
        raise ValueError(f"no value for {bad[0]!r}")
    return name.strip().strip("\"'"), {k: v for k, _, v in pairs}


def grid_values(spec: str) -> tuple[str, list[str]]:
    """key=v1,v2 as (key, values)."""
    key, eq, values = spec.partition("=")
    if not (key and eq and values):
        raise ValueError(f"not KEY=V1,V2: {spec!r}")
    return key, values.split(",")


def sample_spec(spec: str) -> tuple[str, int]:
    name, eq, n = spec.rpartition("=")
    if not (eq and name and n.isdigit() and int(n) > 0):
        raise ValueError(f"not NAME=N with N > 0: {spec!r}")
    return name, int(n)


# -- sinks -----------------------------------------------------------------------------------
def sweep_rows(runs: DataFrame) -> DataFrame:
    """Runs with the time as text of three decimals, ready for write.csv."""
    return runs.withColumn("time_s", F.format_string("%.3f", "time_s"))


def save_runs(runs: DataFrame, path: str) -> None:
    """Each run's outputs, a folder per config: rows of runs without any output and error text are left out."""
    named = runs.withColumn("name", F.concat_ws("_s", F.concat_ws(".", "split", "config"), F.col("seed").cast("string")))
    named.where("coalesce(stdout, '') <> '' or coalesce(stderr, '') <> ''").withColumn("stats", stats_of(F.col("stdout"))).write.partitionBy("config").mode("append").parquet(path)


def sections_json(rows: DataFrame) -> DataFrame:
    """One object of sections, each an object of its keys; of a repeated key the last by ``nth`` counts (rows: nth, section, key, value)."""
    last = rows.groupBy("section", "key").agg(F.max_by("value", "nth").alias("value"), F.max("nth").alias("nth"))
    cells = F.array_sort(F.collect_list(F.struct("nth", "key", "value"))).alias("cells")
    listed = F.array_sort(F.collect_list(F.struct("section", "cells")))
    object_of = lambda cells: F.map_from_entries(F.transform(cells, lambda x: F.struct(x["key"], x["value"])))
    every = F.map_from_entries(F.transform(listed, lambda s: F.struct(s["section"], object_of(s["cells"]))))
    return last.groupBy("section").agg(cells).agg(F.to_json(every).alias("value"))


def tally_rows(tallied: DataFrame, split: str | None = None) -> DataFrame:
    """A tally's rows as a table of texts and numbers, ready for write.csv: times with three decimals, blank where there is none."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    fast = lambda s: [blank(F.format_string("%.3f", F.col(f"fastest_{s}").cast("double"))).alias(f"fastest_{s}_time_s"), blank(F.col(f"fastest_{s}_seed")).alias(f"fastest_{s}_seed")]
    timed = [F.when(F.col(f"fastest_{s}").isNull(), F.lit("")).otherwise(c).alias(name) for s in ("sat", "unsat") for c, name in zip(fast(s), (f"fastest_{s}_time_s", f"fastest_{s}_seed"), strict=True)]
    counts = [F.col(f"n_{s}").alias(s) for s in ("sat", "unsat", "timeout", "unknown", "error") if f"n_{s}" in tallied.columns]
    return tallied.select(*([blank(F.col(split)).alias("split")] if split else []), "config", F.col("runs").alias("total"), *counts, *timed)


def tally_json(tallied: DataFrame, split: str | None = None) -> DataFrame:
    """A tally's rows as objects: the fastest runs as objects of time_s and seed, null where there is none."""
    fast = lambda s: F.when(F.col(f"fastest_{s}").isNotNull(), F.struct(F.round(F.col(f"fastest_{s}").cast("double"), 3).alias("time_s"), F.col(f"fastest_{s}_seed").alias("seed"))).alias(f"fastest_{s}")
    counts = [F.col(f"n_{s}").alias(s) for s in ("sat", "unsat", "timeout", "unknown", "error") if f"n_{s}" in tallied.columns]
    row = F.struct("config", F.col("runs").alias("total"), *counts, fast("sat"), fast("unsat"), *([F.col(split).alias("split")] if split else []))
    return tallied.select("config", *([split] if split else []), F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def comparison_rows(means: DataFrame, configs: list[str], summary: dict[str, str] | None = None, key: str = "key") -> DataFrame:
    """Means as texts, ready for write.csv: whole ones below 10^12 without decimals, others with three, the difference with one, blank for none.

    ``summary``: each config's results, a row of its own before the statistics (``nth`` 0).
    """
    whole = lambda c: (c == F.floor(c)) & (F.abs(c) < 1e12)
    text = lambda c: F.coalesce(F.when(whole(c), c.cast("long").cast("string")).otherwise(F.format_string("%.3f", c)), F.lit(""))
    shown = lambda c: F.when(F.col(f"`{c}`").isNull(), "").otherwise(text(F.col(f"`{c}`"))).alias(c)
    two = [F.when(F.col("diff_pct").isNull(), "").otherwise(F.format_string("%.1f", "diff_pct")).alias("diff_pct")] if len(configs) == 2 else []
    out = means.select(F.lit(1).alias("nth"), F.col(key).alias("stat"), *[shown(c) for c in configs], *two)
    if not summary:
        return out
    row = [0, "result", *[summary.get(c, "") for c in configs], *([""] if two else [])]
    return means.sparkSession.createDataFrame([tuple(row)], out.schema).unionByName(out)


def comparison_json(means: DataFrame, configs: list[str], counts: DataFrame, key: str = "key") -> DataFrame:
    """One row: the configs, their numbers of seeds (``seed_counts``) and each statistic's means, as one object."""
    by_key = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*[F.col(f"`{c}`").alias(c) for c in configs]).alias("v")))))
    seeds = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("config", "seeds")))).alias("seed_counts"))
    found = means.agg(by_key.alias("stats")).crossJoin(seeds)
    listed = F.array(*map(F.lit, configs)).alias("configs")
    return found.select(F.to_json(F.struct(listed, "seed_counts", "stats"), {"ignoreNullFields": "false"}).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def inject(text: Column, extra: str | Column) -> Column:
    """``extra`` before the first line that holds (check-sat) outside a comment; without one, ``extra`` and (check-sat) at the end."""
    extra = F.lit(extra) if isinstance(extra, str) else extra
    lines = F.split(text, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.split(x, ";")[0].contains("(check-sat)")), F.lit(True)).cast("int")
    head, tail = F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines))
    return F.when(at > 0, F.array_join(F.concat(head, F.array(extra), tail), "\n")).otherwise(F.concat(text, F.lit("\n"), extra, F.lit("\n(check-sat)")))
