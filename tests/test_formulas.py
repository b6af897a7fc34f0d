"""Formulas read by spans and forms: the same terms as a reader of the whole text finds, wherever the text is cut."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import dag
from tracelake.sources import smt2


def formula(seed, asserts=25):
    r = random.Random(seed)
    names = [f"v{i}" for i in range(6)]

    def term(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice([*names, "1", "2.50", "|a (b|", '"t ("', "tw"])
        k = r.random()
        if k < 0.15:
            return f"(let ((z {term(depth - 1)})) (+ z {term(depth - 1)}))"
        if k < 0.25:
            return f"(twice {term(depth - 1)})"
        return "(" + r.choice(["+", "*", "ite", "<", "g"]) + "".join(r.choice([" ", "\n", " ; ( comment\n"]) + term(depth - 1) for _ in range(r.randint(1, 3))) + ")"

    lines = [f"(declare-const {n} {r.choice(['Int', 'Bool'])})" for n in names]
    lines += ["(declare-fun g (Int) Bool)", "(declare-fun |a (b| () Real)", "(define-fun twice ((a Int))\n Int (* 2 a))", "(define-const tw Int (twice v0))", '(set-info :source |x\n) "\n|)', '(echo "a "" (\n b")']
    lines += [f"(assert {term(r.randint(0, 4))})" + r.choice(["\n", " ", "\n; )\n"]) for _ in range(asserts)]
    return "\n".join(lines)


def whole(text):
    found = smt2.Dag(text)
    printed = {}
    for i, n in enumerate(found.nodes):
        printed[i] = f"({n['head']} {' '.join(printed[a] for a in n['children'])})" if n["children"] else n["head"]
    return found, printed


@pytest.mark.parametrize("span", [1, 2, 7, 4096])
def test_terms_are_those_of_the_whole_text(spark, span):
    texts = {f"f{i}": formula(i) for i in range(4)} | {"empty": "", "none": "(check-sat) ; (\n"}
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    nodes, edges = smt2.dag_of_lines(smt2._lines(files), span)
    shown = {(r.file, r.id): r.text for r in smt2.term_texts(files, 10**9).collect()}
    got = sorted((r.file, shown[r.file, r.id], r.kind, r.sort, r.arity, r.num_value, r.depth, r.root) for r in nodes.collect())
    links = sorted((r.file, shown[r.file, r.parent], r.pos, shown[r.file, r.child]) for r in edges.collect())
    want, want_links = [], []
    for file, text in texts.items():
        found, printed = whole(text)
        want += [(file, printed[i], n["kind"], n["sort"], n["arity"], n["num_value"], n["depth"], n["root"]) for i, n in enumerate(found.nodes)]
        want_links += [(file, printed[a], pos, printed[b]) for a, pos, b in found.edges]
    key = lambda x: tuple(map(str, x))
    assert sorted(map(key, got)) == sorted(map(key, want)) and links == sorted(want_links)


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    text = formula(9, 400)
    (tmp_path / "big.smt2").write_text(text)
    nodes, _ = smt2.read_smt2(spark, str(tmp_path))
    assert nodes.count() == len(smt2.Dag(text).nodes)
    cut = smt2.forms(smt2.lines_of(spark, str(tmp_path)).withColumnRenamed("trace_id", "file"), 16)
    assert cut.count() == len(smt2.parse(text))


@pytest.mark.parametrize("text", ["(assert (x)", "(assert x))", ') (', '(echo "a)', "(a |b)"])
def test_unbalanced_text_is_an_error(spark, text):
    with pytest.raises(Exception, match="unbalanced"):
        smt2.dag_tables(spark.createDataFrame([("f", text)], "file string, text string"))[0].count()


def test_long_terms_that_differ_at_their_ends_are_different(spark):
    long = " ".join(["x"] * 6000)
    text = f"(declare-const x Int) (assert (< (+ {long} 1) 0)) (assert (< (+ {long} 2) 0)) (assert (> (+ {long} 2) 0))"
    files = spark.createDataFrame([("f", text)], "file string, text string")
    nodes, edges = smt2.dag_tables(files)
    sums = nodes.where("head = '+'").select("file", "id")
    assert dag.distinct_matches(sums, nodes).count() == 2
    assert {len(r.text) for r in dag.distinct_matches(sums, nodes, smt2.term_texts(files)).collect()} == {10_000}
    deep = "x"
    for _ in range(200):  # a print of 2^200 characters
        deep = f"(let ((y {deep})) (+ y y))"
    nodes, _ = smt2.dag_tables(spark.createDataFrame([("f", f"(assert (= {deep} 0))")], "file string, text string"))
    assert nodes.count() == 203 and dag.distinct_matches(nodes.select("file", "id"), nodes).count() == 203


def test_definitions_beyond_what_is_broadcast(spark, monkeypatch):
    files = spark.createDataFrame([("f", formula(3)), ("g", formula(4))], "file string, text string")
    count = lambda: sorted((r["file"], r["printed"]) for r in smt2.dag_tables(files)[0].collect())
    before = count()
    monkeypatch.setattr(smt2, "GIVEN", 0)
    assert count() == before


def test_depths(spark):
    nodes, _ = smt2.dag_tables(spark.createDataFrame([("f", "(declare-const x Int) (assert (< x 3))"), ("g", "(assert true)")], "file string, text string"))
    assert {r["file"]: r["n"] for r in dag.summary(nodes).where(F.col("key") == "max_depth").collect()} == {"f": 1, "g": 0}
