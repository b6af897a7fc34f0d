"""Scans, range joins and rounds that are dealt over spans: equal to one pass over a whole log, for any span."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import core, rounds

EVENTS = "trace_id string, at long, kind string, a long, b long"


def logs(seed, n=5, length=120):
    r = random.Random(seed)
    out = []
    for t in range(n):
        level = 0
        for i in range(r.choice([1, 7, length])):
            kind = r.choice("DDPNNA")
            if kind == "D":
                level += r.randint(0, 3)
                e = ("D", level, 0)
            elif kind == "P":
                drop = r.randint(0, 4)
                level = max(0, level - drop)
                e = ("P", drop, level)
            else:
                e = (kind, 0, 0)
            out.append((f"t{t}", 3 * i + r.randint(0, 2), *e))
    return out


def one_by_one(events):
    out = []
    for t in sorted({e[0] for e in events}):
        machine = rounds.Machine()
        for _, _, kind, a, b in sorted(e for e in events if e[0] == t):
            out += [(t, *r.values()) for r in machine.feed(kind, a, b)]
        out += [(t, *r.values()) for r in machine.finish()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("span", [1, 5, 17, 64, None])
def test_rounds_equal_the_machine_for_any_span(spark, span):
    for seed in (range(6) if span == 17 else range(2)):
        events = logs(seed)
        df = spark.createDataFrame(events, EVENTS).repartition(3)
        assert sorted((tuple(r) for r in rounds.rounds(df, span).collect()), key=repr) == one_by_one(events)
        levels = {(r["trace_id"], r["emission"]): r["level"] for r in rounds.emission_levels(df, span).collect()}
        want, now, n = {}, {}, {}
        for t, _, kind, a, b in sorted(events):
            if kind in "DP":
                now[t] = a if kind == "D" else b
            elif kind == "N":
                n[t] = n.get(t, 0) + 1
                want[t, n[t]] = now.get(t, 0)
        assert levels == want


def test_rounds_of_nothing(spark):
    assert rounds.rounds(spark.createDataFrame([], EVENTS)).count() == 0
    assert rounds.rounds(spark.createDataFrame([("t", 1, "D", 3, 0)], EVENTS)).count() == 0


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_scans(spark, span):
    r = random.Random(span)
    rows = [(k, at, r.choice([None, r.randint(0, 9)])) for k in "ab" for at in r.sample(range(-20, 60), 40)] + [("a", None, 5), (None, 3, 1)]
    found = core.scanned(spark.createDataFrame(rows, "k string, at long, v long").repartition(3), "k", "at", {"s": F.col("v")}, {"l": F.col("v")}, span)
    got = sorted(((x.k, x.at, x.v, x.s, x.l) for x in found.collect()), key=repr)
    want = []
    for k in "ab":
        s, last = 0, None
        for _, at, v in sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0)):
            last = v if v is not None else last
            want.append((k, at, v, s, last))
            s += v or 0
    assert got == sorted(want, key=repr)


def test_range_join_finds_all_and_only_the_pairs(spark):
    r = random.Random(4)
    ranges = [(r.choice("ab"), i, low, low + r.choice([-3, 0, 1, 7, 64, 5000])) for i, low in enumerate(r.choices(range(-100, 300), k=80))] + [("a", 900, None, 3), ("b", 901, 0, 2**50)]
    points = [(r.choice("abc"), i, r.randint(-150, 6000)) for i in range(200)] + [("a", 999, None)]
    df, rf = spark.createDataFrame(points, "k string, p long, x long"), spark.createDataFrame(ranges, "k string, n long, low long, high long")
    want = sorted((p[1], q[1]) for p in points for q in ranges if None not in (p[2], q[2]) and p[0] == q[0] and q[2] <= p[2] <= q[3])
    assert sorted((x.p, x.n) for x in core.in_ranges(df, rf, ["k"], "x", "low", "high").collect()) == want
    assert sorted((x.p, x.n) for x in core.in_ranges(df, rf, ["k"], "x", "low", "high", width=50).collect()) == want
    everywhere = sorted((p[1], q[1]) for p in points for q in ranges if None not in (p[2], q[2]) and q[2] <= p[2] <= q[3])
    assert sorted((x.p, x.n) for x in core.in_ranges(df.drop("k"), rf.drop("k"), [], "x", "low", "high").collect()) == everywhere
    real = [(i, r.uniform(-5, 5)) for i in range(60)] + [(61, float("nan")), (62, float("inf"))]
    spans = [(i, a, a + r.uniform(0, 3)) for i, a in enumerate(r.uniform(-6, 6) for _ in range(30))]
    got = core.in_ranges(spark.createDataFrame(real, "p long, x double"), spark.createDataFrame(spans, "n long, low double, high double"), [], "x", "low", "high", width=0.25)
    assert sorted((x.p, x.n) for x in got.collect()) == sorted((p[0], q[0]) for p in real for q in spans if q[1] <= p[1] <= q[2])
    assert core.in_ranges(df, rf.limit(0), ["k"], "x", "low", "high").count() == 0


def test_only_pairs_inside_are_joined(spark):
    """A range of a million places and as many points cost a row for each size of interval, not a pair for each two."""
    points = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("x"))
    ranges = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("low"), (F.col("id")).alias("high"))
    joined = core.in_ranges(points, ranges, ["k"], "x", "low", "high")
    assert joined.count() == 1000 and "CartesianProduct" not in joined._jdf.queryExecution().toString() and "BroadcastNestedLoop" not in joined._jdf.queryExecution().toString()


@pytest.mark.parametrize("span", [1, 4, 500])
def test_ranges_carried_to_their_points(spark, monkeypatch, span):
    monkeypatch.setattr(core, "SPAN", span)
    r = random.Random(span)
    ranges = [(k, n, 10 * n, 10 * n + r.randint(0, 9), f"r{n}") for k in "ab" for n in r.sample(range(20), 9)]
    points = [(r.choice("abc"), i, r.randint(0, 220)) for i in range(150)]
    found = core.in_last_range(spark.createDataFrame(points, "k string, p long, x long"), spark.createDataFrame(ranges, "k string, n long, low long, high long, name string"), "k", "x", "low", "high")
    assert sorted((x.p, x.name) for x in found.collect()) == sorted((p[1], q[4]) for p in points for q in ranges if p[0] == q[0] and q[2] <= p[2] <= q[3])


def test_no_rows_are_broadcast_to_their_spans(spark):
    """By the size of the files alone a plan takes rows for few, and sends them to all tasks in place of their spans."""
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("trace_id"), F.col("id").alias("at"))
    plan = core.scanned(rows, "trace_id", "at", {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
