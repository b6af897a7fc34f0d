"""Queries of reports: lemmas of odd forms, trace differences, closures, and tables and objects of runs and rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import core, dag, lemmas, rounds, stats
from tracelake.plans.catalog import _KINDS, ROUNDS_SQL, _formulas, _lemma_log, _round_events, _t, query
from tracelake.plans.solver import _entries
from tracelake.sources import results, smt2, trace, trace_source
from tracelake.streaming.event_time import first_of, first_within
from tracelake.streaming.segments import ENTRY, streamed_segments


# -- lemmas -------------------------------------------------------------------------------------
def _odd_lemmas(spark, sf_dir):
    """A lemma per order, of one of two tags: assignments before the conclusion, or without one; inner spaces; a root first; unbounded values."""
    o = _t(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    first = F.array(line("(9) strategy ", k), line("  root  =  r", k, " "), line("x = 5   ", c, "   BASE"), line("( 7 ) not numbered"), line("y  =  ", k, " := z"))
    last = F.array(line("(2)  j1   >= ", c), F.lit("==>  j1  <  j2 "), line("j1 := (*  a   ", k, ")"), F.lit("root = a  b"), line("w = base [0,  ", c, "]  also  j1 :=  (+  p   q)"), F.lit("(free   text)"))
    body = F.when(F.col("o_orderkey") % 2 == 0, first).otherwise(F.concat(first, last))
    tag = F.when(F.col("o_custkey") % 3 == 0, "other").otherwise("nla_solver")
    return o.select(F.col("o_orderstatus").alias("trace_id"), F.col("o_orderkey").alias("line_number"), tag.alias("tag"), F.lit("~lemma_builder").alias("function"), body.alias("body"))


@query("""SELECT o_orderkey AS line_number, unnest(['root', 'x', 'y']) AS name, unnest(['r' || o_orderkey, '5 ' || o_custkey, o_orderkey || ' := z']) AS value, NULL AS bounds, NULL AS definition, NULL AS root, unnest([false, true, false]) AS is_basic FROM orders
UNION ALL SELECT o_orderkey, unnest(['j1', 'w']), NULL, unnest([NULL, '[0,  ' || o_custkey || ']']), unnest(['(* a ' || o_orderkey || ')', '(+ p q)']), unnest(['a b', NULL]), unnest([false, true]) FROM orders WHERE o_orderkey % 2 = 1""")
def lemma_odd_lines(spark, sf_dir):
    """Assignments before a conclusion and without one count; values and definitions have no runs of spaces."""
    return lemmas.variables(lemmas.lemmas(_odd_lemmas(spark, sf_dir))).select("line_number", "name", "value", "bounds", "definition", "root", "is_basic")


@query("""SELECT o_orderkey AS line_number, '(9) strategy' AS strategy, o_orderkey::INT AS lemma_id, CASE WHEN o_orderkey % 2 = 1 THEN 'j1  <  j2' END AS conclusion,
CASE WHEN o_orderkey % 2 = 1 THEN '-:( 7 ) not numbered|2:j1 >= ' || o_custkey ELSE '-:( 7 ) not numbered' END AS preconditions FROM orders""")
def lemma_all_tags(spark, sf_dir):
    """Lemmas of every tag; the first line is never a precondition."""
    found = lemmas.lemmas(_odd_lemmas(spark, sf_dir))
    shown = F.array_join(F.transform("preconditions", lambda p: F.concat(F.coalesce(p["index"].cast("string"), F.lit("-")), F.lit(":"), p["expression"])), "|")
    return found.select("line_number", "strategy", "lemma_id", "conclusion", shown.alias("preconditions"))


# -- differences of logs ------------------------------------------------------------------------
#: The change of a count as text, in SQL.
NOTE = """CASE WHEN a = b THEN '=' ELSE CASE WHEN b > a THEN '+' ELSE '' END || (b - a) || CASE WHEN a = 0 THEN '' ELSE ' (' || CASE WHEN b > a THEN '+' ELSE '' END || round_even((b - a) * 100.0::DOUBLE / a, 0)::BIGINT || '%)' END END"""


@query(f"""WITH k AS (SELECT 'm' || (c_custkey % 16) < 'm2' AS f, '(div I' || c_nationkey || ' R7)' AS v, c_custkey % 3 AS d, lower(c_mktsegment) AS strategy FROM customer),
m AS (SELECT f, 'total' AS section, unnest(['entries', 'entries', 'lemmas', 'calls']) AS key FROM k UNION ALL SELECT f, 'function', unnest(['~lemma_builder', 'show_varmap']) FROM k UNION ALL SELECT f, 'strategy', strategy FROM k
UNION ALL SELECT f, 'fingerprint', substr(sha1(array_to_string(list_sort([v || ' >= ' || d, '==> ' || v || ' < 5']), chr(10)) || chr(10)), 1, 12) FROM k),
c AS (SELECT section, key, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM m GROUP BY 1, 2 HAVING section <> 'fingerprint' OR greatest(a, b) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY greatest(a, b) DESC, key)::INT AS rank FROM c)
SELECT section, key, a, b, {NOTE} AS note, rank FROM r WHERE rank <= 4""")
def trace_diff_calls(spark, sf_dir):
    """Two halves of a log by totals, functions, strategies and repeated fingerprints."""
    return stats.trace_diff(stats.trace_metrics(_lemma_log(spark, sf_dir)), F.col("trace_id") < "m2", 4)


@query(f"""WITH e AS (SELECT o_orderpriority < '3' AS f, o_orderkey % 7 AS a, o_orderkey // 8 % 6 AS k FROM orders),
m AS (SELECT f, CASE k WHEN 2 THEN 'check' ELSE 'function' END AS section, CASE k WHEN 0 THEN 'patch_monomials_on_to_refine' WHEN 1 THEN '~lemma_builder' WHEN 2 THEN 'check' WHEN 3 THEN 'init_to_refine' ELSE 'is_patch_blocked' END AS key FROM e WHERE k <> 5
UNION ALL SELECT f, 'strategy', '<unknown>' FROM e WHERE k = 1 UNION ALL SELECT f, 'total', 'lemmas' FROM e WHERE k = 1 UNION ALL SELECT f, 'total', 'entries' FROM e WHERE k <> 5),
c AS (SELECT section, key, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY greatest(a, b) DESC, key)::INT AS rank FROM c),
p AS (SELECT count(*) FILTER (f AND a < 3) AS a, count(*) FILTER (NOT f AND a < 3) AS b, count(*) FILTER (NOT f AND a < 3) * 100.0::DOUBLE / count(*) FILTER (NOT f) - count(*) FILTER (f AND a < 3) * 100.0::DOUBLE / count(*) FILTER (f) AS d FROM e WHERE k = 4)
SELECT section, key, a, b, {NOTE} AS note, rank FROM r WHERE rank <= 3
UNION ALL SELECT 'patch', 'blocked', a, b, CASE WHEN d = 0 THEN '=' ELSE CASE WHEN d > 0 THEN '+' ELSE '' END || printf('%.0fpp', round_even(d, 0)) END, 1 FROM p""")
def trace_diff_rates(spark, sf_dir):
    """Lemmas without a strategy, and the share of blocked patches in whole percentage points."""
    e = _entries(spark, sf_dir)
    e = e.withColumn("body", F.when(F.col("function") == "~lemma_builder", F.array(F.lit("  "), F.lit("x = 1"))).otherwise(F.col("body")))
    return stats.trace_diff(stats.trace_metrics(e), F.col("trace_id") < "3", 3)


# -- runs ---------------------------------------------------------------------------------------
def _split_tally(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").withColumn("split", F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string"))).withColumnRenamed("o_orderpriority", "config")
    return core.tally(runs, ["split", "config"], "o_orderstatus", "o_totalprice", "o_orderkey", kinds=_KINDS)


_SPLIT_TALLY = """WITH t AS (SELECT 's' || (o_custkey % 7) AS split, o_orderpriority AS config, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS sat, count(*) FILTER (o_orderstatus = 'O') AS unsat, count(*) FILTER (o_orderstatus = 'P') AS timeout,
0::BIGINT AS error, min(o_totalprice) FILTER (o_orderstatus = 'F') AS ft, arg_min(o_orderkey, (o_totalprice, o_orderkey)) FILTER (o_orderstatus = 'F') AS fs, min(o_totalprice) FILTER (o_orderstatus = 'O') AS ut,
arg_min(o_orderkey, (o_totalprice, o_orderkey)) FILTER (o_orderstatus = 'O') AS us FROM orders GROUP BY 1, 2)
"""


@query("""WITH c AS (SELECT o_custkey % 7 AS split, bool_or(o_orderstatus IN ('F', 'O') AND o_custkey % 7 <> 3) AS closed FROM orders GROUP BY 1)
SELECT count(*) AS splits, count(*) FILTER (closed) AS n_closed, bool_and(closed) AS all_closed FROM c""")
def all_splits_closed(spark, sf_dir):
    solved = (F.col("n_sat") + F.col("n_unsat") > 0) & (F.col("split") != "s3")
    return core.all_closed(core.closures(_split_tally(spark, sf_dir), "split", solved))


@query(_SPLIT_TALLY + """SELECT split, config, total, sat, unsat, timeout, error, coalesce(printf('%.3f', ft::DOUBLE), '') AS fastest_sat_time_s, coalesce(fs::VARCHAR, '') AS fastest_sat_seed,
coalesce(printf('%.3f', ut::DOUBLE), '') AS fastest_unsat_time_s, coalesce(us::VARCHAR, '') AS fastest_unsat_seed FROM t""")
def tally_table(spark, sf_dir):
    """A tally as a table of texts, written and read again."""
    at = f"{results.scratch(spark)}/tally"
    results.tally_rows(_split_tally(spark, sf_dir), "split").write.csv(at, header=True)
    found = spark.read.csv(at, header=True, inferSchema=False)
    counts = ("total", "sat", "unsat", "timeout", "error")
    return found.select("split", "config", *[F.col(c).cast("long").alias(c) for c in counts], *[F.coalesce(c, F.lit("")).alias(c) for c in found.columns if c.startswith("fastest")])


@query(_SPLIT_TALLY + """SELECT split, config, total, sat, coalesce(round(ft::DOUBLE, 3)::VARCHAR, 'null') || '/' || coalesce(us::VARCHAR, 'null') AS fastest FROM t""")
def tally_objects(spark, sf_dir):
    """A tally as objects, read again."""
    found = results.tally_json(_split_tally(spark, sf_dir), "split")
    at = lambda path: F.coalesce(F.get_json_object("value", path), F.lit("null"))
    return found.select("split", "config", at("$.total").cast("long").alias("total"), at("$.sat").cast("long").alias("sat"), F.concat(at("$.fastest_sat.time_s"), F.lit("/"), at("$.fastest_unsat.seed")).alias("fastest"))


_MEANS = """WITH v AS (UNPIVOT (SELECT l_linestatus, l_quantity::DOUBLE AS quantity, CASE WHEN l_linestatus = 'F' THEN 7.0::DOUBLE END AS only_f, 0.0::DOUBLE AS zero FROM lineitem) ON quantity, only_f, zero INTO NAME key VALUE value),
m AS (SELECT key, round(avg(value) FILTER (l_linestatus = 'F'), 6) AS a, round(avg(value) FILTER (l_linestatus = 'O'), 6) AS b FROM v GROUP BY 1)
"""


def _means(spark, sf_dir):
    own = F.when(F.col("l_linestatus") == "F", 7.0)
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("config"), own.alias("own"), F.col("l_quantity").cast("double").alias("q"))
    rows = rows.select("config", F.expr("stack(3, 'quantity', q, 'only_f', own, 'zero', 0.0D) AS (key, value)"))
    means = core.stat_means(rows, ["F", "O"])
    a, b = (F.round(c, 6).alias(c) for c in ("F", "O"))
    return means.select("key", a, b, "diff_pct")


@query(_MEANS + """SELECT 0 AS nth, 'result' AS stat, 'sat' AS F, '' AS O, '' AS diff_pct UNION ALL SELECT 1, key, coalesce(CASE WHEN a = floor(a) THEN a::BIGINT::VARCHAR ELSE printf('%.3f', a) END, ''),
coalesce(CASE WHEN b = floor(b) THEN b::BIGINT::VARCHAR ELSE printf('%.3f', b) END, ''), coalesce(CASE WHEN a <> 0 THEN printf('%.1f', (b - a) / abs(a) * 100) END, '') FROM m""")
def comparison_table(spark, sf_dir):
    """Statistics of two configurations as texts, their results first."""
    return results.comparison_rows(_means(spark, sf_dir), ["F", "O"], {"F": "sat"})


@query(_MEANS + "SELECT key, a, b, 2::BIGINT AS seeds FROM m")
def comparison_object(spark, sf_dir):
    """The comparison as one object, read again; a mean that is missing is null."""
    seeds = results.seed_counts(_t(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("config"), (F.col("l_orderkey") % 2).alias("seed")))
    value = results.comparison_json(_means(spark, sf_dir), ["F", "O"], seeds)
    kind = "struct<configs: array<string>, seed_counts: map<string, bigint>, stats: map<string, struct<F: double, O: double>>>"
    found = value.select(F.from_json("value", kind).alias("x")).select(F.explode("x.stats").alias("key", "m"), F.col("x.seed_counts")["F"].alias("seeds"))
    return found.select("key", F.col("m.F").alias("a"), F.col("m.O").alias("b"), "seeds")


# -- rounds -------------------------------------------------------------------------------------
_FIGURES = ROUNDS_SQL + """, f AS (SELECT trace_id, unnest(['round climb (max-N)', 'end-drop (N - target)', 'round length (events)']) AS metric, unnest([climb, end_drop, length]) AS value FROM rounds WHERE closed_strict
UNION ALL SELECT trace_id, 'internal pop drop', a FROM s WHERE role = 'in' AND kind = 'P' UNION ALL SELECT trace_id, 'N at NLA emission', level FROM s WHERE kind = 'N'),
l AS (SELECT trace_id, metric, list_sort(list(value)) AS v, count(*) AS n, round(avg(value), 2) AS mean FROM f GROUP BY 1, 2),
every AS (SELECT trace_id, unnest(['round climb (max-N)', 'end-drop (N - target)', 'internal pop drop', 'round length (events)', 'N at NLA emission']) AS metric FROM (SELECT DISTINCT trace_id FROM e)),
q AS (SELECT trace_id, metric, coalesce(n, 0) AS n, coalesce(v[1], 0) AS min, coalesce(v[n // 4 + 1], 0) AS q1, coalesce(v[n // 2 + 1], 0) AS median, coalesce(v[3 * n // 4 + 1], 0) AS q3, coalesce(v[n], 0) AS max, coalesce(mean, 0) AS mean FROM every LEFT JOIN l USING (trace_id, metric))
"""


@query(_FIGURES + "SELECT * FROM q")
def round_table(spark, sf_dir):
    """Quartiles of every log's rounds: climbs, falls, lengths, drops inside rounds, levels of emissions."""
    return rounds.round_table(_round_events(spark, sf_dir))


@query(_FIGURES + """SELECT q.trace_id AS label, (SELECT count(*) FROM rounds r WHERE r.trace_id = q.trace_id) AS rounds, max(n) FILTER (metric = 'internal pop drop') AS drops, max(median) FILTER (metric = 'N at NLA emission') AS level FROM q GROUP BY q.trace_id""")
def round_objects(spark, sf_dir):
    """A log's totals and quartiles as one object, read again."""
    events = _round_events(spark, sf_dir)
    value = rounds.round_json(rounds.round_totals(events, rounds.rounds(events)), rounds.round_table(events))
    at = lambda path: F.get_json_object("value", path).cast("long")
    return value.select("label", at("$.totals.rounds").alias("rounds"), at("$.quartiles['internal pop drop'].n").alias("drops"), at("$.quartiles['N at NLA emission'].median").alias("level"))


# -- formulas -----------------------------------------------------------------------------------
@query("SELECT n_name AS file, 4::BIGINT AS depth FROM nation")
def formula_depth(spark, sf_dir):
    """A constant's depth is 0."""
    nodes, _ = smt2.dag_tables(_formulas(spark, sf_dir))
    return dag.summary(nodes).where("section = 'summary' and key = 'max_depth'").select("file", F.col("n").alias("depth"))


# -- logs as sources and streams ----------------------------------------------------------------
def _logs(spark, sf_dir):
    """The lines of 16 logs, a block per event."""
    e = _t(spark, sf_dir, "events")
    body = F.array(F.concat(F.lit("event "), F.col("event_id").cast("string")), F.coalesce("props", F.lit("")))
    name = F.concat(F.lit("log-"), (F.col("user_id") % 16).cast("string"))
    return trace.rendered(e, "event_id", F.col("event_type"), F.concat(F.lit("on_"), "event_type"), body, name)


def _entry_rows(entries):
    event = F.regexp_extract(F.col("body")[0], r"event (\d+)", 1).cast("long")
    return entries.select(F.regexp_extract("trace_id", r"log-\d+", 0).alias("log"), "entry_id", "line_number", event.alias("event_id"), "tag", "function", F.col("body")[1].alias("props"))


_LOG_ROWS = """SELECT 'log-' || (user_id % 16) AS log, row_number() OVER w AS entry_id, (row_number() OVER w - 1) * 4 + 1 AS line_number, event_id, event_type AS tag, 'on_' || event_type AS function, coalesce(props, '') AS props
FROM events WINDOW w AS (PARTITION BY user_id % 16 ORDER BY event_id)"""


@query(_LOG_ROWS)
def log_source(spark, sf_dir):
    """Log files read by their own data source, cut at block ends."""
    at = results.scratch(spark)
    _logs(spark, sf_dir).repartition("trace_id").sortWithinPartitions("trace_id", "line_number").select("line", "trace_id").write.partitionBy("trace_id").text(at)
    return _entry_rows(trace_source.read_trace(spark, at))


#: States in RocksDB, and no batches without data, which a processing-time timer would ask for as long as the stream runs.
STATEFUL = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@query(_LOG_ROWS)
def log_stream(spark, sf_dir):
    """A stream of lines cut into entries, each log's open block as its state; the result is a table."""
    at = results.scratch(spark)
    lines = _logs(spark, sf_dir)
    lines.write.parquet(f"{at}-lines")
    results.run_stream(spark, streamed_segments(spark.readStream.schema(lines.schema).parquet(f"{at}-lines")), at, STATEFUL)
    return _entry_rows(spark.read.schema(ENTRY).parquet(at))


@query("""WITH v AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
j AS (SELECT v.user_id, v.event_id, v.ts, arg_min(p.event_id, (p.ts, p.event_id)) AS result FROM v JOIN p ON p.user_id = v.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 2 HOUR GROUP BY ALL)
SELECT user_id, event_id, result FROM j""")
def first_results_streamed(spark, sf_dir):
    """For each view of a stream the first purchase of its user within two hours, by event time."""
    at = results.scratch(spark)
    stream = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    ts = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))  # the same in every time zone
    side = lambda kind: stream.where(F.col("event_type") == kind).select("user_id", "event_id", ts.alias("ts"))
    # The table is in no order of time: nothing in it is late.
    found = first_within(side("view"), side("purchase"), "user_id", "ts", "event_id", "2 hours", late="36500 days")
    results.run_stream(spark, found, at, {})
    return first_of(spark.read.schema(found.schema).parquet(at), "user_id", "ts", "event_id").select("user_id", "event_id", "result")
