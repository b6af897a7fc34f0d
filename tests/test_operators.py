import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.operators import core, dag, lemmas, rounds, stats, sweep
from tracelake.sources import results, smt2, trace


def block(tag, function, *body, closed=True):
    return ["-" * 8 + f" [{tag}] {function} src/a.cpp:12 " + "-" * 9, *body, *(["-" * 48] if closed else [])]


def entries(spark, *blocks):
    lines = [x for b in blocks for x in b]
    return trace.segment(spark.createDataFrame([("t", i + 1, x) for i, x in enumerate(lines)], "trace_id string, line_number long, line string"))


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


def test_segment_header_inside_a_block_is_body_and_an_open_tail_is_dropped(spark):
    inner = block("x", "f")[0]
    found = entries(spark, ["noise"], block("a", "f", "one", inner), ["between"], block("b", "g"), block("c", "h", "lost", closed=False)).orderBy("line_number").collect()
    assert [(r.tag, r.function, r.line_number, r.body, r.entry_id) for r in found] == [("a", "f", 2, ["one", inner], 1), ("b", "g", 7, [], 2)]


def test_search_counts_and_limits(spark):
    e = entries(spark, block("a", "f", "Éa 12", "b"), block("a", "f", "éa 3", "éa 4"))
    assert core.search_count(e, "ÉA", ignore_case=True).first() == (2, 3)
    assert core.search_count(e, "éa", ignore_case=True, most=1).first() == (1, 1)
    assert [r.line for r in core.search_lines(e, "a", invert=True).collect()] == ["b"]
    assert [r.abs_line for r in core.search_lines(e, r"\d", most=2).collect()] == [2, 6]


def test_rounds_follow_the_state_machine(spark):
    events = [("D", 5, 0), ("D", 10, 0), ("N", 0, 0), ("D", 15, 0), ("N", 0, 0), ("A", 0, 0), ("D", 20, 0), ("P", 13, 7), ("D", 12, 0), ("N", 0, 0), ("D", 15, 0), ("P", 5, 13), ("P", 10, 8), ("N", 0, 0)]
    df = spark.createDataFrame([("t", i, *e) for i, e in enumerate(events)], "trace_id string, at long, kind string, a long, b long")
    found = rounds.rounds(df).orderBy("round").collect()
    assert [(r.first_emission, r.anchor) for r in found] == [(1, 10), (3, 12), (4, 8)]
    assert [r.climb for r in found] == [10, 3, None]
    assert [r.end_drop for r in found] == [3, 4, None]
    assert [r.length for r in found] == [4, 2, None]
    assert [r.internal_drop for r in found] == [0, 5, 0]
    assert [(r.last_emission, r.closed) for r in found] == [(2, True), (3, True), (4, False)]
    assert [r.level for r in rounds.emission_levels(df).orderBy("emission").collect()] == [10, 15, 12, 8]
    total = rounds.round_totals(df, rounds.rounds(df)).first()
    assert (total.rounds, total.closed, total.emissions, total.decisions, total.pops, total.conflicts, total.max_level) == (3, 2, 4, 6, 3, 1, 20)


def test_productivity(spark):
    patches = [block("nla_solver", "patch_monomials_on_to_refine", "sz = 5, m_to_refine = 2 less")] + [block("nla_solver", "patch_monomials_on_to_refine", "sz = 5, m_to_refine = 5 same")] * 3
    r = rounds.productivity(entries(spark, *patches, *[block("nla_solver", "~lemma_builder", "x")] * 8)).first()
    assert (r["rate"], r["yield"], r.available) == (0.25, 0.375, True)


def test_lemma_calls_pair_in_order_and_resolve_names(spark):
    lemma = ["order_lemma 12", "(3) j87 >= 1", "==> j82 < 4", "j87 := (* R188 j82)"]
    names = ["varmap: j87=4: (* R188 j82) j82=3: (div I176 R188)"]
    e = entries(spark, block("nla_solver", "~lemma_builder", *lemma), block("nla_solver", "m", *names), block("nla_solver", "~lemma_builder", *lemma), block("nla_solver", "m", "varmap: junk"))
    found = lemmas.lemma_calls(e).collect()
    assert len(found) == 1
    assert found[0].constraints == ["(* R188 (div I176 R188)) >= 1", "==> (div I176 R188) < 4"]
    assert found[0].target == "(* R188 (div I176 R188))"
    row = lemmas.lemmas(e).first()
    assert (row.strategy, row.lemma_id, row.conclusion, row.preconditions[0]["index"]) == ("order_lemma", 12, "j82 < 4", 3)


def test_pools_take_the_next_result(spark):
    e = entries(spark, block("nra", "check", "nra result l_true"), block("nra", "check", " |- !(x0 - x1 < 0)", " |- x1 > 0"), block("nra", "check", "neutral"), block("nra", "check", "nra result l_false"), block("nra", "check", " |- x1 > 0", " |- !(x0 - x1 < 0)"))
    found = lemmas.pool_calls(e).orderBy("index").collect()
    assert [r.result for r in found] == ["l_false", None]
    assert found[0].constraints == ["not x0 - x1 < 0", "x1 > 0"]
    assert lemmas.repeats(lemmas.pool_calls(e)).first().n == 2
    assert lemmas.calls(e)[1] == "nra"


def test_text_functions(spark):
    assert one(spark, "(or #4422 (and #4427 #4422))", X.coarse_signature) == "(or #A0 (and #A1 #A0))"
    assert one(spark, "R7 <= -5 / 4", X.coarse_signature) == "R7 <= LIT"
    assert one(spark, "(* CANON123!!8) <= 0", X.coarse_signature) == "(* CANON123!!8) <= LIT"
    assert one(spark, [], X.fingerprint, "array<string>") == "da39a3ee5e6b"
    assert one(spark, str(2**256), X.constant_text) == f"2^256 ({len(str(2**256))} digits)"
    assert one(spark, str(2**70 - 1), X.number_text) == "2^70-1"
    assert one(spark, "1234567", X.number_text) == "1_234_567"
    assert one(spark, "propagate value - lower bound of range is above value", X.strategy_text) == "low>val"
    assert [one(spark, n, X.ceil_log2, "int") for n in (1, 2, 3, 8, 9)] == [0, 1, 2, 3, 4]


def test_numbers_show_any_power_of_two(spark):
    values = {2**600: "2^600", 2**1024 - 1: "2^1024-1", 2**2000 + 1: "2^2000+1", -(2**513): "-2^513", 2**513 + 2: f"{2**513 + 2:_}", 2**512 + 1: "2^512+1"}
    rows = spark.createDataFrame([(str(v),) for v in values], "v string")
    found = {r.v: r.t for r in rows.select("v", X.number_text(F.col("v")).alias("t")).collect()}
    assert found == {str(v): t for v, t in values.items()}
    assert one(spark, f"(mod R2 {2**600})", X.humanise_constants) == "(mod R2 2^600)"


def test_summary_counts_shapes(spark):
    text = "(declare-const p Bool) (declare-const x Int) (assert (< (div (ite p x 2) 3) (* x (ite p x 2)))) (assert (< (mod x 3) (* (ite p 1 x) x)))"
    nodes, edges = smt2.dag_tables(spark.createDataFrame([("a", text)], "file string, text string"))
    found = {r.key: r.n for r in dag.summary(nodes, edges).where("section = 'shapes'").collect()}
    assert [found[s] for s in dag.SHAPES] == [1, 1, 2, 1, 0, 1, 1]


def test_even_sample_and_quartiles(spark):
    df = spark.range(10).withColumn("k", F.lit(1))
    assert [r.id for r in core.even_sample(df, "k", "id", 4).orderBy("id").collect()] == [0, 2, 5, 7]
    q = core.floor_quartiles(spark.range(1, 5).withColumn("k", F.lit(1)), "k", "id").first()
    assert (q.q1, q["median"], q.q3, q["mean"]) == (2, 3, 4, 2.5)


def test_stats_text_and_specs(spark):
    text = "sat\nunsat\n(:max-memory 17.76\n :conflicts 1)\n"
    assert one(spark, text, results.result_of) == "unsat"
    assert one(spark, text, results.stats_of) == {"max-memory": "17.76", "conflicts": "1"}
    assert one(spark, "no stats", results.stats_of) is None
    assert results.seeds("0-3,7") == [0, 1, 2, 3, 7]
    assert results.index_ranges("3,5:6,2-4,:2", 9) == [3, 5, 6, 2, 4, 1]
    assert results.config('a: x=1 "y=b c"') == ("a", {"x": "1", "y": "b c"})
    with pytest.raises(ValueError):
        results.index_ranges("4-2", 9)
    assert one(spark, "(a)\n; (check-sat)\n(check-sat)", lambda c: results.inject(c, "(b)")) == "(a)\n; (check-sat)\n(b)\n(check-sat)"


def test_patterns(spark):
    files = spark.createDataFrame([("f", "(declare-const p Bool) (declare-const x Int) (assert (or p (< (+ x x) (let ((y (* 2 x))) (ite p y 3))))) (assert (not p))")], "file string, text string")
    nodes, edges = smt2.dag_tables(files)
    count = lambda p: dag.find(nodes, edges, p).count()
    assert [count(p) for p in ("(+ ?a ?a)", "(+ ?a ?b)", "(* 2 _)", "?x:Numeral", "(if ?g _ _)", "!?x:Var", "(< _ _ _)")] == [1, 1, 1, 2, 1, 8, 0]
    assert [r.value for r in dag.fixed_bools(nodes, edges).collect()] == [False]
    assert dag.candidates(nodes, edges).count() == 0
    for bad in ("(", "()", "(f)", "?x:Nope", "a b", ")"):
        with pytest.raises(dag.PatternError):
            dag.parse_pattern(bad)


def test_conflict_statistics(spark):
    e = entries(spark, block("arith_conflict", "f", "@1 conflict", "(if a) l_true", "x (mod 2) l_false", "BLK__1 BLK__1 1000000"), block("arith_conflict", "f", "(if (div 2)) l_undef", "y l_true", "BLK__1"))
    assert [r.n for r in stats.premise_shapes(e).collect()] == [1, 1, 1, 1]
    rows = {(r.section, r.key): r.value for r in stats.stats(e)["arith_conflict"].collect()}
    assert rows["blocks", "BLK__1"] == 2 and rows["constants", "1000000"] == 1 and rows["summary", "conflicts"] == 2
    assert stats.conflict_diff(e, e).where("delta <> 0").count() == 0


def test_sweep_stops_splits_and_times_out(spark):
    jobs = sweep.work(spark, [("a", "fa"), ("b", "fb")], [("c", {"x": "1"})], [0, 1])
    found = sweep.sweep(jobs, ["/bin/sh", "-c", "if [ {file} = fa ]; then echo sat; else sleep 5; fi"], timeout_s=1, parallel=1, stop_split_on={"sat"}, closed={"z": "known"})
    assert sorted((r.split, r.status) for r in found.collect()) == [("a", "sat"), ("b", "timeout"), ("b", "timeout"), ("z", "unsat")]


def test_tactics_slices_and_checks_name_what_is_wrong(spark, tmp_path):
    assert dag.parse_tactic("simplify") == ["simplify"] and dag.parse_tactic("(then a b)") == ["a", "b"]
    for bad in ("", "a b", "(or-else a b)", "(then)", "(then a (then b c))"):
        with pytest.raises(dag.PatternError):
            dag.parse_tactic(bad)
    ranges = spark.createDataFrame([("t", 1, 1, 2), ("t", 2, 3, 3)], "trace_id string, round int, a int, b int")
    points = spark.createDataFrame([("t", i) for i in range(5)], "trace_id string, i int")
    assert [r.i for r in core.range_slice(points, ranges, ["trace_id"], "i", "a", "b", "round", 1).orderBy("i").collect()] == [1, 2]
    with pytest.raises(ValueError, match="1, 2"):
        core.range_slice(points, ranges, ["trace_id"], "i", "a", "b", "round", 7)
    # However often the ranges are looked at, they are found once.
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = ranges.mapInArrow(counted, ranges.schema)
    assert core.range_slice(points, found, ["trace_id"], "i", "a", "b", "round", 2).count() == 1 and seen.value == 2
    for spec in (str(tmp_path), "=x", f"{tmp_path}/none"):
        with pytest.raises(ValueError):
            results.label_paths([spec])
    with pytest.raises(ValueError, match="config bad"):
        sweep.preflight(spark, [("good", {}), ("bad", {})], ["/bin/sh", "-c", "[ {config} = good ] && echo sat || echo no such option"], "f")


def test_running_total_is_dealt_over_spans(spark, monkeypatch):
    monkeypatch.setattr(core, "SPAN", 7)
    rows = [(k, i, (i * 37) % 11) for k in "ab" for i in range(40)]
    found = core.running_total(spark.createDataFrame(rows, "k string, at long, x long"), "k", "at", F.col("x"), "before").collect()
    assert len(found) == 80 and all(r.before == sum(x for k, i, x in rows if k == r.k and i < r.at) for r in found)
    noise = [x for i in range(30) for x in block("t", f"f{i}", *["line"] * (i % 5))]
    assert [(r.function, r.entry_id, len(r.body)) for r in entries(spark, noise).orderBy("entry_id").collect()] == [(f"f{i}", i + 1, i % 5) for i in range(30)]


def test_runs_are_saved_by_config(spark, tmp_path):
    runs = spark.createDataFrame([("s", "c", 1, "sat", 0.1, "sat\n(:n 4)\n", ""), ("s", "d", 2, "error", 0.1, "", "no"), ("s", "d", 3, "sat", 0.1, "", "")], sweep.RUN)
    results.save_runs(runs, f"{tmp_path}/runs")
    back = {r.name: r for r in spark.read.parquet(f"{tmp_path}/runs").collect()}
    assert set(back) == {"s.c_s1", "s.d_s2"} and back["s.c_s1"].stats == {"n": "4"} and back["s.d_s2"].config == "d"


def test_jobs_of_plans_skip_missing_leaves(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "plan.json").write_text('{"leaves": [{"file": "x.smt2", "pruned": false}, {"file": "gone.smt2", "pruned": false}, {"file": "y.smt2", "pruned": true}]}')
    (tmp_path / "a" / "x.smt2").write_text("(check-sat)")
    configs, seeds = spark.createDataFrame([("c", {})], "config string, params map<string,string>"), spark.createDataFrame([(0,), (1,)], "seed int")
    plans = results.read_plans(spark, str(tmp_path))
    assert [(r.split, r.file, r.seed) for r in sweep.plan_jobs(plans, configs, seeds, str(tmp_path)).orderBy("seed").collect()] == [("x.smt2", f"{tmp_path}/a/x.smt2", 0), ("x.smt2", f"{tmp_path}/a/x.smt2", 1)]
    assert sweep.plan_jobs(plans, configs, seeds).count() == 4


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(2000))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("one\r\n\r\nthree")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several blocks of a file
    try:
        found = trace.lines_of(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_number, r.line) for r in found if r.trace_id.endswith("a.log")) == [(i + 1, f"line {i}") for i in range(2000)]
    assert sorted((r.line_number, r.line) for r in found if r.trace_id.endswith("b.log")) == [(1, "one"), (2, ""), (3, "three")]
    assert sorted(map(tuple, trace.lines_of(spark, str(tmp_path), whole=True).collect())) == sorted(map(tuple, found))


def test_index_ranges_end_at_the_total():
    assert results.index_ranges("5:200", 100) == list(range(5, 101))
    assert results.index_ranges("150:200,7,200,98-", 100) == [150, 7, 200, 98, 99, 100]


def test_injection_inside_a_line_and_without_a_check(spark):
    put = lambda c: results.inject(c, "(b)")
    assert one(spark, "(assert p) (check-sat)", put) == "(b)\n(assert p) (check-sat)"
    assert one(spark, "(assert p) ; (check-sat)", put) == "(assert p) ; (check-sat)\n(b)\n(check-sat)"


def test_lemmas_of_all_tags_and_their_lines(spark):
    e = entries(spark, block("a", "~lemma_builder", "x 1", "v =  5   6", "w := (*  a   b)"), block("nla_solver", "~lemma_builder"), block("b", "~lemma_builder", "(1) first", "root = r", "k", "=> c", "(late)"))
    found = lemmas.lemmas(e)
    assert found.count() == 3 and lemmas.lemmas(e, "nla_solver").count() == 1
    rows = {(r.line_number, r.name): (r.value, r.definition, r.root) for r in lemmas.variables(found).collect()}
    assert rows == {(1, "v"): ("5 6", None, None), (1, "w"): (None, "(* a b)", None), (8, "root"): ("r", "k", None)}
    last = found.orderBy("line_number").collect()[-1]
    assert (last.strategy, last.preconditions, last.conclusion) == ("(1) first", [], "c")


def test_names_of_a_log_are_joined_to_its_texts(spark):
    texts = spark.createDataFrame([("t", 1, "j1 + j22 = j3"), ("t", 2, None), ("t", 3, ""), ("u", 1, "j1 j1")], "trace_id string, line_number long, conclusion string")
    names = spark.createDataFrame([("t", "j1", "x 4096"), ("t", "j22", "y"), ("u", "j1", "z")], "trace_id string, name string, expr string")
    got = {(r.trace_id, r.line_number): r.conclusion for r in lemmas.with_names(texts, names, "conclusion", humanised=True).collect()}
    assert got == {("t", 1): "x 2^12 + y = j3", ("t", 2): None, ("t", 3): "", ("u", 1): "z z"}


def test_first_of_each_and_whole_points(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    found = core.first_of_each(df, "k", [F.desc("v")], 2).orderBy("k", "rank").collect()
    assert [(r.k, r.v, r["rank"]) for r in found] == [(0, 999, 1), (0, 996, 2), (1, 997, 1), (1, 994, 2), (2, 998, 1), (2, 995, 2)]
    assert [one(spark, x, X.whole_points_delta, "double") for x in (0.0, 2.5, -0.3, 12.0)] == ["=", "+2pp", "-0pp", "+12pp"]


def test_execute_deals_jobs_of_one_file_over_tasks(spark):
    jobs = spark.range(40).coalesce(1).selectExpr("'s' split", "'f' file", "'c' config", "cast(map() as map<string,string>) params", "cast(id as int) seed")
    found = sweep.execute(jobs, ["/bin/sh", "-c", "echo sat; echo {seed}"])
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted((r.seed, r.status, r.stdout) for r in found.collect()) == [(i, "sat", f"sat\n{i}\n") for i in range(40)]


def test_variables_are_found_in_the_lemmas_own_rows(spark):
    """No sort, aggregate or join: a lemma's lines move nowhere; a repeated name keeps its first value, definition and root."""
    said = ["root = r0", "x = 5 a BASE", "free", "root = r1", "y := b  c", "x = 7 [0, 1] so := d", "root = r2", "(late)"]
    found = spark.createDataFrame([("t", 1, said), ("t", 2, ["free only"]), ("t", 3, [])], "trace_id string, line_number long, assignments array<string>")
    rows = lemmas.variables(found)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Aggregate", "Join", "Window"))
    assert [tuple(r)[2:] for r in rows.orderBy("first_pos").collect()] == [
        ("root", "r0", None, None, None, False, 0), ("x", "5 a", "[0, 1]", "free", "r1", True, 1), ("y", None, None, "b c", None, False, 4),
    ]


def test_metrics_of_a_log_go_through_its_entries_once(spark):
    lemma = lambda at, body: ("t", at, "nla_solver", "~lemma_builder", body)
    rows = [lemma(1, ["s 7", "(1) j1 >= 2", "==> j1 < 5"]), ("t", 5, "nla_solver", "show_varmap", ["varmap: j1=4: R7"]), lemma(9, [""]), ("t", 12, "nla_solver", "is_patch_blocked", ["blocked"]), ("t", 15, "other", "f", [])]
    rows += [("u", 1, "nra", "check", ["|- x < 1", "nra result l_true"]), ("t", 20, "nra", "check", ["|- x < 1"])]
    entries = spark.createDataFrame(rows, "trace_id string, line_number long, tag string, function string, body array<string>")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = stats.trace_metrics(entries.mapInArrow(counted, entries.schema)).collect()
    assert seen.value == len(rows)
    of = {(r.trace_id, r.section, r.key): r.n for r in found if r.section != "fingerprint"}
    assert of == {
        ("t", "function", "~lemma_builder"): 2, ("t", "function", "show_varmap"): 1, ("t", "function", "is_patch_blocked"): 1, ("t", "patch", "blocked"): 1,
        ("t", "total", "entries"): 4, ("t", "total", "lemmas"): 2, ("t", "strategy", "s"): 1, ("t", "strategy", "<unknown>"): 1, ("t", "total", "calls"): 1, ("u", "total", "calls"): 1,
    }
    assert sorted((r.trace_id, r.n) for r in found if r.section == "fingerprint") == [("t", 1), ("u", 1)]
