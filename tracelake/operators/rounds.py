"""Rounds of a search: levels rise between emissions until a pop falls below the round's anchor.

Events are (trace, order, kind, a, b): kind D (a: the new level), P (a: levels dropped, b: the new
level), A (a conflict) and N (an emission). Where a round starts depends on where the one before ended:
``Machine`` goes through one log event by event, for streams, and ``rounds`` through spans of logs at once.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.core import floor_quartiles, in_last_range, scanned
from tracelake.sources.results import stored

ROUND = "trace_id string, round long, anchor long, first_emission long, last_emission long, climb long, end_drop long, length long, internal_pops long, internal_drop long, closed boolean, closed_strict boolean"


class Machine:
    """The state of one trace; ``feed`` takes an event and returns the rounds that it ended."""

    def __init__(self, state: dict | None = None):
        self.s = state or {"level": 0, "n": 0, "round": 0, "open": None, "ended": None}

    def feed(self, kind: str, a: int, b: int) -> list[dict]:
        s, out = self.s, []
        r = s["open"]
        if kind == "D":
            s["level"] = a
            if r:
                r["length"] += 1
                r["top"] = max(r["top"], a)
        elif kind == "P":
            s["level"] = b
            if r and b >= r["anchor"]:
                r["length"] += 1
                r["internal_pops"] += 1
                r["internal_drop"] += a
            elif r:
                s["ended"] = r | {"climb": r["top"] - r["anchor"], "end_drop": r["anchor"] - b}
                s["open"] = None
        elif kind == "A":
            if r:
                r["length"] += 1
        elif kind == "N":
            s["n"] += 1
            if s["ended"]:  # only the next emission marks a round as closed
                out.append(self.row(s["ended"], s["n"] - 1, True, True))
                s["ended"] = None
            if r:
                r["length"] += 1
            else:
                s["round"] += 1
                s["open"] = {"round": s["round"], "anchor": s["level"], "first": s["n"], "top": s["level"], "length": 0, "internal_pops": 0, "internal_drop": 0}
        return out

    def finish(self) -> list[dict]:
        s = self.s
        if s["ended"]:
            return [self.row(s["ended"], s["n"], False, True)]
        return [self.row(s["open"], s["n"], False, False)] if s["open"] else []

    @staticmethod
    def row(r: dict, last: int, closed: bool, strict: bool) -> dict:
        return {"round": r["round"], "anchor": r["anchor"], "first_emission": r["first"], "last_emission": last, "climb": r.get("climb"), "end_drop": r.get("end_drop"), "length": r["length"] if strict else None, "internal_pops": r["internal_pops"], "internal_drop": r["internal_drop"], "closed": closed, "closed_strict": strict}


def events_of(entries: DataFrame) -> DataFrame:
    """Round events of log entries."""
    body, tag = F.array_join("body", "\n"), F.col("tag")
    number = lambda p, i=1: F.regexp_extract(body, p, i).try_cast("long")
    decide, pop = r"splitting, lvl:\s*(\d+)", r"backtracking:\s*(\d+),\s*new_lvl:\s*(\d+)"
    kind = F.when((tag == "decide") & body.rlike(decide), "D").when((tag == "pop_scope") & body.rlike(pop), "P").when((tag == "arith_conflict") & body.rlike(r"@(\d+)\s+(conflict|lemma)"), "A").when((tag == "nla_solver") & (F.col("function") == "~lemma_builder"), "N")
    a = F.when(kind == "D", number(decide)).when(kind == "P", number(pop))
    return entries.select("trace_id", F.col("line_number").alias("at"), kind.alias("kind"), F.coalesce(a, F.lit(0)).alias("a"), F.coalesce(F.when(kind == "P", number(pop, 2)), F.lit(0)).alias("b")).where("kind is not null")


class Span:
    """The events of one span of a log, each with the level before it and the emissions before it.

    ``after[i]`` is the state behind event i if no round is open there, as (anchor of the round open at the span's end or
    None, rounds opened until then). It follows from the next emission's, so one walk from the end finds all of them.
    """

    def __init__(self, at: list[int], kind: list[str], a: list[int], b: list[int], level: list[int], before: list[int]):
        self.rows = list(zip(at, kind, a, b, level, before, strict=True))
        lowest: list[tuple[int, int]] = []  # pops that are lower than all nearer ones, the nearest last
        heights: list[int] = []  # their levels: the nearest is the highest
        next_open: tuple[int | None, int] = (None, 0)
        states: dict[int, tuple[int | None, int]] = {}
        for i in range(len(kind) - 1, -1, -1):
            if kind[i] == "P":
                while lowest and lowest[-1][0] >= b[i]:
                    lowest.pop()
                    heights.pop()
                states[i] = next_open
                lowest.append((b[i], i))
                heights.append(b[i])
            elif kind[i] == "N":
                nth = bisect.bisect_left(heights, level[i]) - 1  # heights rise towards the nearest: the last one below the anchor
                anchor, n = states[lowest[nth][1]] if nth >= 0 else (level[i], 0)
                next_open = anchor, n + 1
        self.closed = next_open
        self.open = [(low, *states[i]) for low, i in lowest]

    def partial_rounds(self, anchor: int | None, number: int) -> Iterator[dict]:
        """What this span knows of each round, given the state before it: the open round's anchor (None: none) and the last round's number."""
        now = {"round": number, "top": anchor, "length": 0, "pops": 0, "drop": 0} if anchor is not None else None
        for at, kind, a, b, level, before in self.rows:
            if kind == "N" and now is None:
                if number:
                    yield {"round": number, "last": before}
                number, anchor = number + 1, level
                now = {"round": number, "top": level, "length": 0, "pops": 0, "drop": 0, "anchor": level, "first": before + 1, "start_at": at}
            elif now is None:
                continue
            elif kind == "P" and b < anchor:
                yield now | {"floor": b, "end_at": at}
                now = None
            else:
                now["length"] += 1
                if kind == "D":
                    now["top"] = max(now["top"], a)
                elif kind == "P":
                    now["pops"] += 1
                    now["drop"] += a
        if now:
            yield now


def _by_span(batches: Iterator[pa.RecordBatch], take: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``take`` (first row, span -> rows) over the runs of equal (trace_id, _span) of sorted batches; only one span is held."""
    names = ("at", "kind", "a", "b", "_level", "_before")
    held: dict[str, list] = {c: [] for c in names}
    head, out = None, []
    for batch in batches:
        rows = batch.to_pydict()
        ids = list(zip(rows["trace_id"], rows["_span"], strict=True))
        at = 0
        while at < len(ids):
            if head is not None and ids[at] != (head["trace_id"], head["_span"]):
                out += take(head, Span(*held.values()))
                held, head = {c: [] for c in names}, None
            end = at
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            head = head or {c: v[at] for c, v in rows.items()}
            for c in names:
                held[c] += rows[c][at:end]
            at = end
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if head is not None:
        yield pa.RecordBatch.from_pylist(take(head, Span(*held.values())), schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


#: A span as a function of what is open before it: rounds below a pop's level go on as that pop says, others stay open.
TABLE = "trace_id string, _span long, closed_anchor long, closed_rounds long, low array<long>, anchor array<long>, opened array<long>"
BEFORE = "trace_id string, _span long, _anchor long, _round long"
PARTIAL = "trace_id string, round long, anchor long, first long, last long, top long, floor long, length long, pops long, drop long, start_at long, end_at long"


def rounds(events: DataFrame, span: int | None = None, places: bool = False) -> DataFrame:
    """A row per round; with ``places`` also start_at and end_at, the ``at`` of the emission that opens it and of the pop that ends it.

    A log is cut into spans of positions (``span``). Each span, by itself, is turned into a table: which state it ends in
    for a log without an open round, and for an open one by its anchor (only pops lower than all before them in the
    span make a difference). A log's tables, a row a span, are then applied one after the other, and with the state before it
    each span gives its part of every round; the parts of a round are added up. No task holds more than a span
    of events, and where rounds begin is exact for any cut.
    """
    level = {"_now": F.when(F.col("kind") == "D", F.col("a")).when(F.col("kind") == "P", F.col("b"))}
    dealt = scanned(events.select("trace_id", "at", "kind", "a", "b"), "trace_id", "at", {"_before": (F.col("kind") == "N").cast("int")}, level, span, keep_span=True)
    # An emission changes no level, so at it the level up to and with its own event is the one before it.
    dealt = dealt.select("trace_id", "_span", "at", "kind", "a", "b", F.coalesce("_now", F.lit(0)).alias("_level"), "_before")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(head: dict, found: Span) -> list[dict]:
            low, anchor, opened = (list(c) for c in zip(*found.open, strict=True)) if found.open else ([], [], [])
            return [{"trace_id": head["trace_id"], "_span": head["_span"], "closed_anchor": found.closed[0], "closed_rounds": found.closed[1], "low": low, "anchor": anchor, "opened": opened}]

        yield from _by_span(batches, take, _schema(TABLE))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trace, anchor, number = None, None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["trace_id"] != trace:
                    trace, anchor, number = row["trace_id"], None, 0
                out.append({"trace_id": trace, "_span": row["_span"], "_anchor": anchor, "_round": number})
                if anchor is None:
                    anchor, number = row["closed_anchor"], number + row["closed_rounds"]
                else:  # the nearest pop below the anchor ends the round; they lie from the lowest, farthest, on
                    at = bisect.bisect_left(row["low"], anchor) - 1
                    if at >= 0:
                        anchor, number = row["anchor"][at], number + row["opened"][at]
            yield pa.RecordBatch.from_pylist(out, _schema(BEFORE))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(head: dict, found: Span) -> list[dict]:
            return [{"trace_id": head["trace_id"]} | r for r in found.partial_rounds(head["_anchor"], head["_round"])]

        yield from _by_span(batches, take, _schema(PARTIAL))

    ordered = dealt.sortWithinPartitions("trace_id", "_span", "at")
    before = ordered.mapInArrow(tables, TABLE).repartition("trace_id").sortWithinPartitions("trace_id", "_span").mapInArrow(states, BEFORE)
    known = dealt.join(before.hint("merge"), ["trace_id", "_span"]).sortWithinPartitions("trace_id", "_span", "at")
    most = lambda c, name=None: F.max(c).alias(name or c)
    found = known.mapInArrow(partial, PARTIAL).groupBy("trace_id", "round").agg(
        *[most(c) for c in ("anchor", "first", "last", "top", "floor", "start_at", "end_at")], *[F.sum(c).alias(c) for c in ("length", "pops", "drop")]
    )
    total = dealt.groupBy("trace_id").agg(F.sum((F.col("kind") == "N").cast("long")).alias("_n"))
    ended = F.col("floor").isNotNull()
    return found.join(total, "trace_id").select(
        "trace_id", "round", "anchor", F.col("first").alias("first_emission"), F.coalesce("last", "_n").alias("last_emission"),
        F.when(ended, F.col("top") - F.col("anchor")).alias("climb"), (F.col("anchor") - F.col("floor")).alias("end_drop"), F.when(ended, F.col("length")).alias("length"),
        F.col("pops").alias("internal_pops"), F.col("drop").alias("internal_drop"), (ended & F.col("last").isNotNull()).alias("closed"), ended.alias("closed_strict"),
        *(["start_at", "end_at"] if places else []),
    )


def lemmas_per_round(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per round (trace_id, round, first_emission, last_emission, closed) the lemmas whose ``index`` it spans, in order.

    ``found``: trace_id, index, strategy, conclusion, preconditions, variables, monomials (their numbers).
    """
    spans = stored(ranges.select("trace_id", "round", "first_emission", "last_emission", "closed"))  # found once, used twice
    each = F.struct("index", *[F.coalesce(c, F.lit("")).alias(c) for c in ("strategy", "conclusion")], "preconditions", "variables", "monomials")
    inside = in_last_range(found, spans, "trace_id", "index", "first_emission", "last_emission")
    listed = inside.groupBy("trace_id", "round").agg(F.array_sort(F.collect_list(each)).alias("lemmas"))
    return spans.join(listed, ["trace_id", "round"], "left")


# Names of the figures of a round table.
METRICS = {"climb": "round climb (max-N)", "end_drop": "end-drop (N - target)", "pop": "internal pop drop", "length": "round length (events)", "level": "N at NLA emission"}
TOTALS = {"rounds": "rounds", "closed": "closed_rounds", "emissions": "nla_emissions", "decisions": "decisions", "pops": "pops", "conflicts": "arith_conflicts", "max_level": "max_decision_level"}


def round_figures(events: DataFrame, span: int | None = None) -> DataFrame:
    """trace_id, metric, value: of every ended round its climb, fall at the end and length, of every pop inside a round its drop, of every emission its level."""
    found = stored(rounds(events, span, places=True))  # found once, used twice
    ended = F.explode(F.array(*[F.struct(F.lit(METRICS[c]).alias("metric"), F.col(c).alias("value")) for c in ("climb", "end_drop", "length")])).alias("x")
    of_rounds = found.where("closed_strict").select("trace_id", ended).select("trace_id", "x.*")
    reach = found.select("trace_id", "start_at", F.coalesce(F.col("end_at") - 1, F.lit((1 << 61) - 1)).alias("until"))
    inside = in_last_range(events.where("kind = 'P'").select("trace_id", "at", "a"), reach, "trace_id", "at", "start_at", "until")
    of_pops = inside.select("trace_id", F.lit(METRICS["pop"]).alias("metric"), F.col("a").alias("value"))
    levels = emission_levels(events, span).select("trace_id", F.lit(METRICS["level"]).alias("metric"), F.col("level").alias("value"))
    return of_rounds.unionByName(of_pops).unionByName(levels)


def round_table(events: DataFrame, span: int | None = None) -> DataFrame:
    """trace_id, metric, n, min, q1, median, q3, max, mean: every log's figures by floor quartiles; zeros for a figure without values."""
    names = F.explode(F.array(*map(F.lit, METRICS.values()))).alias("metric")
    every = events.select("trace_id").distinct().select("trace_id", names)
    found = floor_quartiles(round_figures(events, span), ["trace_id", "metric"], "value")
    return every.join(found, ["trace_id", "metric"], "left").na.fill(0)


def totals_table(totals: DataFrame) -> DataFrame:
    """label, metric, value rows of ``round_totals``."""
    cells = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("long").alias("value")) for c, name in TOTALS.items()])
    return totals.select(F.col("trace_id").alias("label"), F.explode(cells).alias("x")).select("label", "x.*")


def round_json(totals: DataFrame, table: DataFrame) -> DataFrame:
    """label, value: a log's totals and quartiles as one object."""
    figures = F.struct("n", "min", "q1", "median", "q3", "max", "mean")
    quartiles = table.groupBy("trace_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("metric"), figures.alias("q"))))).alias("quartiles"))
    named = F.struct(*[F.col(c).cast("long").alias(name) for c, name in TOTALS.items()])
    return totals.join(quartiles, "trace_id").select(F.col("trace_id").alias("label"), F.to_json(F.struct(named.alias("totals"), "quartiles")).alias("value"))


def round_totals(events: DataFrame, found: DataFrame) -> DataFrame:
    """Per trace: rounds, closed, emissions, decisions, pops, conflicts, max_level."""
    n = lambda k: F.count_if(F.col("kind") == k)
    counts = events.groupBy("trace_id").agg(n("N").alias("emissions"), n("D").alias("decisions"), n("P").alias("pops"), n("A").alias("conflicts"), F.coalesce(F.max(F.when(F.col("kind") == "D", F.col("a"))), F.lit(0)).alias("max_level"))
    per = found.groupBy("trace_id").agg(F.count("*").alias("rounds"), F.count_if("closed").alias("closed"))
    return counts.join(per, "trace_id", "left").na.fill(0, ["rounds", "closed"])


def emission_levels(events: DataFrame, span: int | None = None) -> DataFrame:
    """The level at each emission: the last decision's or pop's, 0 before any."""
    level = F.when(F.col("kind") == "D", F.col("a")).when(F.col("kind") == "P", F.col("b"))
    found = scanned(events.select("trace_id", "at", "kind", "a", "b"), "trace_id", "at", {"_n": (F.col("kind") == "N").cast("int")}, {"_level": level}, span)
    return found.where("kind = 'N'").select("trace_id", "at", F.coalesce("_level", F.lit(0)).alias("level"), (F.col("_n") + 1).alias("emission"))


#: The function whose lines tell what a patch did, and their form.
PATCH, STATUS = "patch_monomials_on_to_refine", r"sz\s*=\s*(\d+)\s*,\s*m_to_refine\s*=\s*(\d+)\s*\(?(less|same|more)\)?"


def productivity(entries: DataFrame) -> DataFrame:
    """Per trace: status counts over the lines of patches, rate of improving ones, evictions (falls only) and their yield per lemma."""
    own = entries.where(F.col("tag") == "nla_solver")
    part = lambda x, i: F.regexp_extract(x, STATUS, i)
    told = F.transform(F.filter("body", lambda x: x.rlike(STATUS)), lambda x: F.struct(part(x, 1).try_cast("long").alias("a"), part(x, 2).try_cast("long").alias("b"), part(x, 3).alias("s")))
    own = own.withColumn("_t", F.when(F.col("function") == PATCH, told).otherwise(F.array().cast("array<struct<a:bigint,b:bigint,s:string>>")))
    fell = F.aggregate("_t", F.lit(0).cast("long"), lambda n, x: n + F.greatest(x["a"] - x["b"], F.lit(0)))
    number = lambda s: F.coalesce(F.sum(F.size(F.filter("_t", lambda x: x["s"] == s))), F.lit(0)).cast("long")
    out = own.groupBy("trace_id").agg(
        *[number(s).alias(f"n_{s}") for s in ("less", "same", "more")],
        F.coalesce(F.sum(fell), F.lit(0)).alias("evictions"),
        F.count_if(F.col("function") == "~lemma_builder").alias("lemmas"),
    )
    classified = F.col("n_less") + F.col("n_same") + F.col("n_more")
    return out.withColumn("available", classified > 0).withColumn("rate", F.try_divide("n_less", classified)).withColumn("yield", F.try_divide("evictions", "lemmas"))


def over_time(levels: DataFrame, found: DataFrame) -> DataFrame:
    """Every emission's level with its round and whether that is closed: the points of a plot and what to shade in it."""
    spans = found.select("trace_id", "round", "closed", "first_emission", "last_emission")
    points = levels.select("trace_id", "emission", "level")
    return in_last_range(points, spans, "trace_id", "emission", "first_emission", "last_emission").drop("first_emission", "last_emission")


def productivity_notes(stats: DataFrame, rate: float = 0.35, yield_: float = 0.40) -> DataFrame:
    """The two figures with a mark below their thresholds, "unavailable" where there is none or no status line was found."""
    note = lambda c, t: F.when(~F.col("available") | F.col(c).isNull(), "unavailable").when(F.col(c) < t, "low").otherwise("ok")
    return stats.select("*", note("rate", rate).alias("rate_note"), note("yield", yield_).alias("yield_note"))
