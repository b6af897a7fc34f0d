"""Per-tag summaries of a log as (section, key, value, total) rows, by a registry of analysers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.operators.core import ab_counts, first_of_each, share_points, with_tags
from tracelake.operators.lemmas import lemma_calls, lemmas, pool_calls
from tracelake.sources.results import stored

# Forms of blocks and constants in conflicts, and the shapes of premises.
BLOCKS, CONSTANTS = r"BLK__\w+", r"\b\d{6,}\b"
SHAPES = ("clean_linear", "ite_wrapped", "mod_div_wrapped", "mixed")


def _rows(df: DataFrame, section: str, *pairs: tuple[str, Column]) -> DataFrame:
    """One row per aggregate."""
    one = df.agg(*[v.cast("double").alias(f"v{i}") for i, (_, v) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"v{i}").alias("value")) for i, (k, _) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("c")).select(F.lit(section).alias("section"), "c.key", "c.value", F.lit(None).cast("double").alias("total"))


def _counts(df: DataFrame, section: str, key: Column, k: int, shown: Column | None = None) -> DataFrame:
    """The most frequent keys and the number of rows; ``shown``: which keys count as such."""
    counts = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("line_number").alias("f")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    counts = (counts if shown is None else counts.where(shown)).orderBy(F.desc("n"), "f", "key").limit(k)
    return counts.select(F.lit(section).alias("section"), "key", F.col("n").cast("double").alias("value"), F.col("total").cast("double").alias("total"))


def overview(entries: DataFrame, k: int = 10, sources: int = 5) -> DataFrame:
    """(tag, section, key, value, total) of every tag at once, in one pass: entries, distinct functions, and the most frequent sources and functions."""
    items = F.array(F.struct(F.lit("sources").alias("section"), X.basename(F.col("source_file")).alias("key")), F.struct(F.lit("functions").alias("section"), F.col("function").alias("key")))
    counts = entries.select("tag", "line_number", F.explode(items).alias("i")).groupBy("tag", "i.section", "i.key").agg(F.count("*").alias("n"), F.min("line_number").alias("f"))
    whole = Window.partitionBy("tag", "section")
    rank = F.row_number().over(whole.orderBy(F.desc("n"), "f", "key"))
    ranked = counts.withColumn("total", F.sum("n").over(whole)).withColumn("different", F.count("*").over(whole)).withColumn("rank", rank)
    # The first function of a tag also tells its entries and functions.
    head = F.array(*[F.struct(F.lit("summary").alias("section"), F.lit(c).alias("key"), F.col(v).cast("double").alias("value"), F.lit(None).cast("double").alias("total")) for c, v in (("entries", "total"), ("functions", "different"))])
    own = F.array(F.struct("section", "key", F.col("n").cast("double").alias("value"), F.col("total").cast("double").alias("total")))
    shown = ranked.where(F.col("rank") <= F.when(F.col("section") == "sources", sources).otherwise(k))
    rows = F.when((F.col("section") == "functions") & (F.col("rank") == 1), F.concat(head, own)).otherwise(own)
    return shown.select("tag", F.explode(rows).alias("r")).select("tag", "r.*")


def generic(entries: DataFrame, k: int = 10) -> DataFrame:
    """The overview of one tag's entries."""
    return overview(entries, k).drop("tag")


def nla_solver(entries: DataFrame, k: int = 10) -> DataFrame:
    body = F.array_join("body", "\n")
    number = lambda p: F.regexp_extract(body, p, 1).try_cast("long")
    calls = F.when(F.col("function") == "check", number(r"calls = (\d+)"))
    refine = F.when(F.col("function") == "init_to_refine", number(r"(\d+) mons? to refine"))
    head = _rows(entries, "summary", ("entries", F.count("*")), ("max_call", F.max(calls)), ("lemmas", F.count_if(F.col("function") == "~lemma_builder")), ("refine_min", F.min(refine)), ("refine_avg", F.avg(refine)), ("refine_max", F.max(refine)))
    return head.unionByName(_counts(entries, "functions", F.col("function"), k))


def nra(entries: DataFrame, k: int = 10) -> DataFrame:
    """Results as a share of check entries, not of those with a result."""
    checks = entries.where("function = 'check'")
    result = F.regexp_extract(F.array_join("body", "\n"), r"nra result (l_\w+)", 1)
    head = _rows(entries, "summary", ("entries", F.count("*")), ("checks", F.count_if(F.col("function") == "check")), ("setups", F.count_if(F.col("function") == "setup_solver_poly")))
    results = _counts(checks.withColumn("_r", result), "results", F.col("_r"), k, F.col("key") != "")
    return head.unionByName(results).unionByName(_counts(entries, "functions", F.col("function"), k))


def premise_shapes(entries: DataFrame) -> DataFrame:
    """The four shapes in a fixed order, zeros included, with the number of premise rows."""
    lines = entries.select(F.explode("body").alias("line")).where(X.is_premise(F.col("line")))
    counts = lines.groupBy(X.premise_shape(F.col("line")).alias("key")).count()
    spark = entries.sparkSession
    every = spark.createDataFrame([(i, s) for i, s in enumerate(SHAPES)], "nth int, key string")
    total = lines.agg(F.count("*").alias("total"))
    return every.join(counts, "key", "left").crossJoin(F.broadcast(total)).select("nth", "key", F.coalesce("count", F.lit(0)).alias("n"), "total").orderBy("nth")


def conflict_items(entries: DataFrame) -> DataFrame:
    """(section, key) of what conflicts hold: each block and constant of an entry once, the shape of every premise row, one entry."""
    text = F.array_join("body", "\n")
    pairs = lambda section, items: F.transform(items, lambda x: F.struct(F.lit(section).alias("section"), x.alias("key")))
    found = [pairs(section, F.array_distinct(F.regexp_extract_all(text, F.lit(f"({regex})")))) for section, regex in (("blocks", BLOCKS), ("constants", CONSTANTS))]
    found.append(pairs("shapes", F.transform(F.filter("body", X.is_premise), X.premise_shape)))
    found.append(pairs("conflicts", F.array(F.lit("conflicts"))))
    return entries.select(*[c for c in ("side",) if c in entries.columns], F.explode(F.concat(*found)).alias("i")).select("*", "i.section", "i.key").drop("i")


def arith_conflict(entries: DataFrame, k: int = 10) -> DataFrame:
    """Conflicts, premise rows, distinct blocks and constants; the most frequent of these; the shapes, zeros included."""
    found = conflict_diff_counts(conflict_items(entries.withColumn("side", F.lit(True))))
    listed = F.col("section").isin("blocks", "constants")
    shown = first_of_each(found.where(listed), ["section"], [F.desc("a"), "key"], k).drop("rank").unionByName(found.where(~listed))
    return shown.select("section", "key", F.col("a").cast("double").alias("value"), F.col("a_total").cast("double").alias("total"))


#: tag -> analyser; add to it to analyse more tags.
ANALYSERS: dict[str, Callable[..., DataFrame]] = {"nla_solver": nla_solver, "nra": nra, "arith_conflict": arith_conflict}


def stats(entries: DataFrame, tags=None, functions=None, k: int = 10) -> dict[str, DataFrame]:
    """A summary per tag that has entries after the filters."""
    entries = with_tags(entries, tags, functions)
    found = [r["tag"] for r in entries.select("tag").distinct().orderBy("tag").collect()]
    return {t: ANALYSERS.get(t, generic)(entries.where(F.col("tag") == t), k) for t in found}


def conflict_diff_counts(items: DataFrame) -> DataFrame:
    """section, key, a, b, a_total, b_total of the items of two sides: summary, blocks, constants (shares of conflicts) and shapes (of premise rows)."""
    counts = ab_counts(items, ["section", "key"], F.col("side")).drop("delta")
    n = lambda side, section: F.coalesce(F.sum(F.when(F.col("section") == section, F.col(side))), F.lit(0))
    kinds = lambda side, section: F.count_if((F.col("section") == section) & (F.col(side) > 0))
    rows = [("conflicts", "conflicts", n), ("premises", "shapes", n), ("blocks", "blocks", kinds), ("constants", "constants", kinds)]
    totals = counts.agg(*[make(side, section).alias(f"{side}_{key}") for key, section, make in rows for side in "ab"])
    none = F.lit(None).cast("long")
    summary = totals.select(F.explode(F.array(*[F.struct(F.lit("summary").alias("section"), F.lit(key).alias("key"), F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), none.alias("a_total"), none.alias("b_total")) for key, _, _ in rows])).alias("r")).select("r.*")
    every = items.sparkSession.createDataFrame([("shapes", s) for s in SHAPES], "section string, key string")
    shapes = every.join(counts.where("section = 'shapes'"), ["section", "key"], "left").na.fill(0, ["a", "b"])
    kept = counts.where("section in ('blocks', 'constants')").unionByName(shapes).crossJoin(F.broadcast(totals))
    of = lambda side: F.when(F.col("section") == "shapes", F.col(f"{side}_premises")).otherwise(F.col(f"{side}_conflicts")).alias(f"{side}_total")
    return summary.unionByName(kept.select("section", "key", "a", "b", of("a"), of("b")))


def conflict_diff(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """Two logs' conflicts: section, key, a, b, delta, a_total, b_total, points (difference of the shares) and note (the change as text).

    The summary; of blocks and constants the first ``k`` of either side, by the larger count, ``k`` at most; all shapes.
    """
    sides = [e.where("tag = 'arith_conflict'").withColumn("side", F.lit(first)) for e, first in ((a, True), (b, False))]
    if any(s.isEmpty() for s in sides):
        raise ValueError("both logs need arith_conflict entries")
    found = conflict_diff_counts(conflict_items(sides[0].unionByName(sides[1])))
    listed = F.col("section").isin("blocks", "constants")
    largest = [first_of_each(found.where(listed & (F.col(side) > 0)), ["section"], [F.desc(side), "key"], k).drop("rank") for side in "ab"]
    both = largest[0].unionByName(largest[1]).dropDuplicates(["section", "key"])
    ranked = first_of_each(both, ["section"], [F.desc(F.greatest("a", "b")), "key"], k).drop("rank").unionByName(found.where(~listed))
    points = share_points(F.col("a"), F.nullif("a_total", F.lit(0)), F.col("b"), F.nullif("b_total", F.lit(0)))
    points = F.coalesce(points, X.share(F.col("b"), F.col("b_total")), -X.share(F.col("a"), F.col("a_total")), F.lit(0.0))
    note = F.when(F.col("section") == "shapes", X.points_delta(points)).otherwise(X.count_delta(F.col("a"), F.col("b")))
    return ranked.select("section", "key", "a", "b", (F.col("b") - F.col("a")).alias("delta"), "a_total", "b_total", F.when(F.col("section") != "summary", points).alias("points"), note.alias("note"))


def blocked_rate(entries: DataFrame) -> DataFrame:
    """Per trace: patches that were asked for, those blocked, and the rate (null without any)."""
    own = entries.where("tag = 'nla_solver' and function = 'is_patch_blocked'")
    counts = own.groupBy("trace_id").agg(F.count_if(X.is_blocked(F.array_join("body", "\n"))).alias("blocked"), F.count("*").alias("patches"))
    return counts.withColumn("rate", F.try_divide("blocked", "patches"))


def metric_diff(metrics: DataFrame, side: Column, k: int | None = None, least_repeats: int = 2) -> DataFrame:
    """Counts (section, key, n) of two sides side by side, each section's largest first; rows that both sides have less than the section's least are out."""
    counts = ab_counts(metrics, ["section", "key"], side, F.col("n"))
    least = F.when(F.col("section") == "fingerprint", least_repeats).otherwise(1)
    counts = counts.where(F.greatest("a", "b") >= least)
    return first_of_each(counts, ["section"], [F.desc(F.greatest("a", "b")), "key"], k)


#: Fixed value: the strategy of a lemma that names none.
UNKNOWN = "<unknown>"


def log_calls(entries: DataFrame) -> DataFrame:
    """The lemma calls of each log, or its pool calls where it has no lemma calls."""
    columns = ["trace_id", "index", "constraints", "fingerprint"]
    found = stored(lemma_calls(entries).select(columns))  # found once, used twice
    pools = pool_calls(entries).select(*columns, F.lit("nra").alias("source")).join(found.select("trace_id").distinct().hint("merge"), "trace_id", "left_anti")
    return found.withColumn("source", F.lit("varmap")).unionByName(pools)


def trace_metrics(entries: DataFrame, fingerprints: bool = True) -> DataFrame:
    """Per trace (section, key, n) rows, for ``metric_diff``: entries, lemmas and calls; functions; blocked patches; lemma strategies; fingerprints of calls.

    The entries are stored once, and entries, lemmas and calls are each gone through once: a row gives all that it counts for.
    """
    entries = stored(entries.select("trace_id", "line_number", "tag", "function", "body"))
    blocked = F.when(X.is_blocked(F.array_join("body", "\n")), "blocked").otherwise("free")
    strategy = F.coalesce(F.nullif("strategy", F.lit("")), F.lit(UNKNOWN))
    item = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    each = lambda df, *items: df.select("trace_id", F.explode(F.array_compact(F.array(*items))).alias("i")).select("trace_id", "i.*")
    patch = F.when(F.col("function") == "is_patch_blocked", item("patch", blocked))
    parts = [each(entries.where("tag = 'nla_solver'"), item("function", F.col("function")), item("total", F.lit("entries")), patch)]
    parts.append(each(lemmas(entries), item("strategy", strategy), item("total", F.lit("lemmas"))))
    if fingerprints:
        parts.append(each(log_calls(entries), item("fingerprint", F.col("fingerprint")), item("total", F.lit("calls"))))
    return reduce(DataFrame.unionByName, parts).groupBy("trace_id", "section", "key").agg(F.count("*").alias("n"))


def trace_diff(metrics: DataFrame, side: Column, k: int = 5) -> DataFrame:
    """Two sides of ``trace_metrics``: section, key, a, b, note (the change as text), rank.

    Totals; calls of check; the ``k`` largest of the other functions, of the strategies, and of the fingerprints that a side has twice or
    more; and the share of blocked patches (a and b: blocked ones; note: whole percentage points).
    """
    check = (F.col("section") == "function") & (F.col("key") == "check")
    counts = metric_diff(metrics.withColumn("section", F.when(check, "check").otherwise(F.col("section"))).where("section <> 'patch'"), side, k)
    listed = counts.select("section", "key", "a", "b", X.count_delta(F.col("a"), F.col("b")).alias("note"), "rank")
    n = lambda on, which: F.coalesce(F.sum(F.when(on & which, F.col("n"))), F.lit(0)).cast("long")
    blocked = F.col("key") == "blocked"
    rate = metrics.where("section = 'patch'").agg(*[n(on, which).alias(c) for on, s in ((side, "a"), (~side, "b")) for c, which in ((s, blocked), (f"{s}_all", F.lit(True)))])
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"{c}_all")) * 100, F.lit(0.0))
    rate = rate.where("a_all + b_all > 0").select(F.lit("patch").alias("section"), F.lit("blocked").alias("key"), "a", "b", X.whole_points_delta(share("b") - share("a")).alias("note"), F.lit(1).alias("rank"))
    return listed.unionByName(rate)
