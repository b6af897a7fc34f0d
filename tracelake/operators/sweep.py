"""External runs over a grid of splits, configurations and seeds; a pluggable command per run."""

from __future__ import annotations

import os
import shutil
import signal
import subprocess
import tempfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.results import scratch
from tracelake.sources.trace import segment

RUN = "split string, config string, seed int, status string, time_s double, stdout string, stderr string"
GRACE_S = 2
#: Characters of output that a task holds before it passes them on.
LOT = 1 << 20


def work(spark: SparkSession, splits: list[tuple[str, str]], configs: list[tuple[str, dict]], seeds: list[int]) -> DataFrame:
    """A row per run: split, file, config, params, seed."""
    s = spark.createDataFrame(splits, "split string, file string")
    c = spark.createDataFrame(configs, "config string, params map<string,string>")
    return s.crossJoin(c).crossJoin(spark.createDataFrame([(x,) for x in seeds], "seed int"))


def _stop(proc: subprocess.Popen) -> None:
    """The run's whole process group: a polite signal, then the other."""
    for sig, wait in ((signal.SIGTERM, GRACE_S), (signal.SIGKILL, None)):
        try:
            os.killpg(proc.pid, sig)
            proc.wait(wait)
            return
        except subprocess.TimeoutExpired:
            continue
        except ProcessLookupError:
            return


def execute(jobs: DataFrame, command: list[str], timeout_s: float = 30, parallel: int | None = None) -> DataFrame:
    """Each job's status (its first output line), time and output.

    ``command`` is formatted with file, seed, config and params ("k=v" each). A run has a folder
    and a process group of its own, both gone afterwards; one that takes ``timeout_s`` is stopped,
    and keeps its split. Jobs are dealt over ``parallel`` tasks (None: four for each of the cluster's slots), however few files they lie in.
    """
    parallel = parallel or 4 * jobs.sparkSession.sparkContext.defaultParallelism

    columns = [f.split()[0] for f in RUN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ended, held = [], 0
            for job in pdf.itertuples(index=False):
                params = dict(job.params or {})
                argv = [a.format(file=job.file, seed=job.seed, config=job.config, params=" ".join(f"{k}={v}" for k, v in sorted(params.items()))) for a in command]
                folder, began = tempfile.mkdtemp(prefix="run-"), time.time()
                out = err = ""
                try:
                    proc = subprocess.Popen(argv, cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, start_new_session=True)
                    try:
                        out, err = proc.communicate(timeout=timeout_s)
                        first = next(iter(out.strip().splitlines()), "").strip()
                        status = first if first in ("sat", "unsat", "unknown", "timeout") else "error"
                    except subprocess.TimeoutExpired:
                        status = "timeout"
                    finally:
                        _stop(proc)
                except OSError as e:
                    status, err = "error", str(e)
                finally:
                    shutil.rmtree(folder, ignore_errors=True)
                ended.append((job.split, job.config, job.seed, status, time.time() - began, out, err))
                held += len(out) + len(err)
                if held >= LOT:  # outputs may be long
                    yield pd.DataFrame(ended, columns=columns)
                    ended, held = [], 0
            yield pd.DataFrame(ended, columns=columns)

    jobs = jobs.select("split", "file", "config", "params", "seed")
    return jobs.repartition(parallel).mapInPandas(run, RUN)


def sweep(jobs: DataFrame, command: list[str], timeout_s: float = 30, parallel: int | None = 4, stop_on: set[str] = frozenset(), stop_split_on: set[str] = frozenset(), closed: dict[str, str] | None = None) -> DataFrame:
    """All runs in waves of ``parallel`` (None: as many as the cluster has slots); after each wave closed splits' jobs leave, and a stop ends it.

    ``stop_on``: statuses that end the sweep ("error" is one: fail fast). ``closed``: splits known to be
    unsat get a made-up row (time 0, seed 0, the first config).
    """
    spark, at = jobs.sparkSession, scratch(jobs.sparkSession)
    parallel = parallel or spark.sparkContext.defaultParallelism
    todo = [r.asDict() for r in jobs.orderBy("split", "config", "seed").collect()]
    first = min((j["config"] for j in todo), default="")
    made_up = spark.createDataFrame([(s, first, 0, "unsat", 0.0, "", why) for s, why in (closed or {}).items()], RUN)
    done, waves = set(closed or {}), []
    while todo := [j for j in todo if j["split"] not in done]:
        wave, todo = todo[:parallel], todo[parallel:]
        waves.append(f"{at}/wave-{len(waves)}")
        execute(spark.createDataFrame(wave, jobs.schema), command, timeout_s, parallel).write.parquet(waves[-1])
        ended = spark.read.schema(RUN).parquet(waves[-1]).select("split", "status").collect()  # outputs stay where they are
        done |= {r.split for r in ended if r.status in stop_split_on}
        if any(r.status in stop_on for r in ended):
            break
    return made_up.unionByName(spark.read.schema(RUN).parquet(*waves)) if waves else made_up


def preflight(spark: SparkSession, configs: list[tuple[str, dict]], command: list[str], probe: str, timeout_s: float = 10) -> None:
    """One short run of every config on the file ``probe``; those that end in an error are named in a ValueError."""
    jobs = work(spark, [("preflight", probe)], configs, [0])
    bad = execute(jobs, command, timeout_s, len(configs)).where("status = 'error'").orderBy("config").collect()
    if bad:
        raise ValueError("; ".join(f"config {r.config}: {(r.stderr or r.stdout).strip()[:200]}" for r in bad))


def captured(runs: DataFrame) -> DataFrame:
    """The entries of the logs that runs wrote to their output: capture, then analyse."""
    name = F.concat_ws("/", "split", "config", F.col("seed").cast("string"))
    lines = runs.select(name.alias("trace_id"), F.posexplode(F.split("stdout", "\r\n|\r|\n")).alias("at", "line"))
    return segment(lines.select("trace_id", (F.col("at") + 1).cast("long").alias("line_number"), "line"))


def plan_jobs(plans: DataFrame, configs: DataFrame, seeds: DataFrame, root: str | None = None) -> DataFrame:
    """Work for every leaf of plans that has a file; with ``root``, the plans' folder, of those whose file is there."""
    kept = F.explode(F.filter("leaves", lambda x: x["file"].isNotNull() & ~F.coalesce(x["pruned"], F.lit(False)))).alias("l")
    leaves = plans.select(*(["path"] if root else []), kept).withColumn("split", F.col("l.file"))
    if root:
        there = plans.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("file"))
        leaves = leaves.withColumn("file", F.concat(F.regexp_replace("path", "/[^/]*$", "/"), "split")).join(there, "file", "left_semi").select("split", "file")
    else:
        leaves = leaves.select("split", F.col("split").alias("file"))
    return leaves.crossJoin(configs).crossJoin(seeds)
