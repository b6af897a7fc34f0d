"""Search, ranking, pairing, windows, differences and tallies over any ordered table.

Order is data: every operator that depends on it takes explicit key and order columns, and ties
end in the key. Functions take and return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tracelake.sources.results import stored


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


# -- search ---------------------------------------------------------------------------------
def pattern(text: str | None, ignore_case: bool = False) -> str:
    """An unanchored pattern; none matches everything; case is folded by Unicode."""
    return ("(?iu)" if ignore_case else "") + (text or "")


def with_tags(df: DataFrame, tags=None, functions=None) -> DataFrame:
    """Rows of exactly these tags and functions (none given: all)."""
    for column, some in (("tag", tags), ("function", functions)):
        if some:
            df = df.where(F.col(column).isin(*_cols(some)))
    return df


def matching(df: DataFrame, column: str, text: str | None, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    hit = F.col(column).rlike(pattern(text, ignore_case))
    return df.where(~hit if invert else hit)


def body_lines(entries: DataFrame) -> DataFrame:
    """One row per body line, with its index and absolute line number."""
    return entries.select("*", F.posexplode("body").alias("idx", "line")).withColumn("abs_line", F.col("line_number") + 1 + F.col("idx")).drop("body")


def search_lines(entries: DataFrame, text: str | None, ignore_case: bool = False, invert: bool = False, most: int | None = None) -> DataFrame:
    found = matching(body_lines(entries), "line", text, ignore_case, invert)
    return found if most is None else found.orderBy("trace_id", "abs_line").limit(most)


def _line_test(text: str | None, ignore_case: bool, invert: bool):
    return lambda x: ~x.rlike(pattern(text, ignore_case)) if invert else x.rlike(pattern(text, ignore_case))


def search_entries(entries: DataFrame, text: str | None, ignore_case: bool = False, invert: bool = False, most: int | None = None) -> DataFrame:
    """Entries with a matching body line."""
    found = entries.where(F.exists("body", _line_test(text, ignore_case, invert)))
    return found if most is None else found.orderBy("trace_id", "line_number").limit(most)


def search_count(entries: DataFrame, text: str | None, ignore_case: bool = False, invert: bool = False, most: int | None = None) -> DataFrame:
    """One row: n_entries, n_lines. With ``most``, entries are taken until the lines before them reach it, so the count may pass it."""
    hits = F.size(F.filter("body", _line_test(text, ignore_case, invert)))
    found = entries.withColumn("_n", hits).where("_n > 0")
    if most is not None:
        found = total_before(found, ["trace_id"], ["line_number"], F.col("_n"), "_before").where(F.col("_before") < most)
    return found.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_lines"))


# -- ranking and distributions -----------------------------------------------------------------
def top_counts(df: DataFrame, keys, k: int | None = None, first: str | None = None, total: Column | None = None) -> DataFrame:
    """Rows per key, most first, with the total; ties by first appearance (``first``), then by key."""
    keys = _cols(keys)
    aggs = [F.count("*").alias("n")] + ([F.min(first).alias("first_at")] if first else [])
    counts = df.groupBy(*keys).agg(*aggs)
    every = df.agg((total if total is not None else F.count("*")).cast("long").alias("total"))
    ranked = counts.orderBy(F.desc("n"), *([F.asc("first_at")] if first else []), *keys)
    return (ranked.limit(k) if k is not None else ranked).crossJoin(F.broadcast(every))


#: Parts that the rows of a key are dealt over before the first of each key are taken from the parts' first.
PARTS = 32


def first_of_each(df: DataFrame, keys, order, k: int | None) -> DataFrame:
    """The first ``k`` rows of each key (all for None) by ``order``, with their rank from 1.

    The limit is applied where rows are, then in ``PARTS`` parts of each key, then to what these leave, so that no task
    gets all rows of a key; without a limit ranks need a key's rows in one order.
    """
    keys, order = _cols(keys), [order] if isinstance(order, str) else list(order)
    row = F.xxhash64(*[c for c in df.columns if c not in keys])
    for by in ([*keys, F.pmod(row, F.lit(PARTS))], keys) if k is not None else (keys,):
        df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        df = df.where(F.col("rank") <= k) if k is not None else df
    return df


def distinct_tally(df: DataFrame, column: str, regex: str, k: int | None = None) -> DataFrame:
    """How many rows hold each match of a pattern: a row counts once for a match."""
    items = F.array_distinct(F.regexp_extract_all(column, F.lit(f"({regex})")))
    counts = df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return counts if k is None else counts.orderBy(F.desc("n"), "item").limit(k)


def floor_quartiles(df: DataFrame, keys, value: str) -> DataFrame:
    """n, min, q1, median, q3, max, mean by floor index of the sorted values; null values don't count.

    Equal values are counted first, and positions are found by running counts: no group is held in memory.
    """
    keys = _cols(keys)
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_c"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("_c").over(whole.orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("n", F.sum("_c").over(whole)).withColumn("_upto", upto)
    at = lambda i: F.coalesce(F.max(F.when((F.col("_upto") - F.col("_c") <= i) & (i < F.col("_upto")), F.col("_v"))), F.lit(0))
    n = F.col("n")
    places = {"min": F.lit(0), "q1": F.floor(n / 4), "median": F.floor(n / 2), "q3": F.floor(3 * n / 4), "max": n - 1}
    mean = F.coalesce(F.round(F.try_divide(F.sum(F.col("_v") * F.col("_c")), F.sum("_c")), 2), F.lit(0.0))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *[at(i).alias(c) for c, i in places.items()], mean.alias("mean"))


#: Positions of a key that one task numbers or adds up.
SPAN = 1 << 16


def scanned(df: DataFrame, key: str, at: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, span: int | None = None, keep_span: bool = False) -> DataFrame:
    """``df`` with running values over the key's rows by the integer ``at`` (nulls first); rows without a key are dropped.

    ``sums``: the sum over the rows before each. ``lasts``: the last value that isn't null up to and with each row.
    Spans of positions are gone through by themselves and what they come to, one row each, put before one
    another, so a key's rows are dealt over many tasks however many they are. ``keep_span``: the column _span, by
    which (with the key) the result lies, stays.
    """
    sums, lasts = sums or {}, lasts or {}
    held = {f"_s{i}": v for i, v in enumerate(sums.values())} | {f"_l{i}": v for i, v in enumerate(lasts.values())}
    dealt = df.withColumns({"_span": F.coalesce(F.floor(F.col(at) / (span or SPAN)), F.lit(-(1 << 62)))} | held).repartition(key, "_span")
    last = lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.coalesce(at, F.lit(-(1 << 62))))).alias(c)
    spans = dealt.groupBy(key, "_span").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in held if c[1] == "s"], *[last(c) for c in held if c[1] == "l"])
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda c: (F.coalesce(F.sum(c).over(before), F.lit(0)) if c[1] == "s" else F.last(c, ignorenulls=True).over(before)["v"]).alias(f"_b{c}")
    spans = spans.select(key, "_span", *[whole(c) for c in held])
    own = Window.partitionBy(key, "_span").orderBy(at)
    inside = {c: F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if c[1] == "s" else F.last(c, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)) for c in held}
    # Rows stay where they are: the spans, a row each, come to them (by its files' size alone, a plan may broadcast the rows).
    joined = dealt.withColumns({f"_i{c}": v for c, v in inside.items()}).join(spans.hint("merge"), [key, "_span"])
    values = [(F.col(f"_b{c}") + F.col(f"_i{c}")).cast("long") if c[1] == "s" else F.coalesce(f"_i{c}", f"_b{c}") for c in held]
    out = joined.withColumns(dict(zip([*sums, *lasts], values, strict=True)))
    return out.drop(*held, *[f"_b{c}" for c in held], *[f"_i{c}" for c in held], *([] if keep_span else ["_span"]))


def running_total(df: DataFrame, key: str, at: str, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows before each (see ``scanned``)."""
    return scanned(df, key, at, sums={name: value})


def total_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` before each row: dealt over spans where one column of whole numbers orders one key's rows."""
    if len(keys) == len(order) == 1 and isinstance(df.schema[order[0]].dataType, IntegralType):
        return running_total(df, keys[0], order[0], value, name)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def renumbered(df: DataFrame, order, keys=(), name: str = "idx") -> DataFrame:
    """Numbers from 1 within each key, by order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))).cast("long"))


def even_sample(df: DataFrame, keys, order, n: int) -> DataFrame:
    """Rows floor(i * total / n) of each key for i < n; all if there are no more than n."""
    if n <= 0:
        raise ValueError("a sample needs at least one row")
    keys = _cols(keys)
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(*_cols(order))) - 1).withColumn("_t", F.count("*").over(w))
    # r is picked iff some i has floor(i t / n) = r: the least i with i t >= r n also has i t < (r + 1) n.
    i = F.ceil(F.col("_r") * n / F.col("_t"))
    return ranked.where((F.col("_t") <= n) | ((i < n) & (F.floor(i * F.col("_t") / n) == F.col("_r")))).drop("_r", "_t")


def lag_changes(df: DataFrame, keys, order, values) -> DataFrame:
    """Each row with the key's values at its previous occurrence (prev_*); first occurrences have none."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return df.select("*", *[F.lag(v).over(w).alias(f"prev_{v}") for v in _cols(values)])


# -- pairing -----------------------------------------------------------------------------------
def fifo_pairs(left: DataFrame, right: DataFrame, keys, order) -> DataFrame:
    """The i-th row of either side of a key, as l_* and r_*, as far as the shorter side goes."""
    keys, order = _cols(keys), _cols(order)

    def side(df: DataFrame, tag: str) -> DataFrame:
        df = total_before(df, keys, order, F.lit(1), "_b").withColumn("pair_no", F.col("_b") + 1).drop("_b")
        return df.select(*keys, "pair_no", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in (*keys, "pair_no")])

    return side(left, "l").join(side(right, "r"), [*keys, "pair_no"])


def next_after(df: DataFrame, keys, order, opens: Column, closes: Column, value: str) -> DataFrame:
    """Each opening row with the first closing row's ``value`` before the next opening (result; null: none)."""
    keys, order = _cols(keys), _cols(order)
    marked = df.withColumn("_open", opens).withColumn("_close", closes & ~opens)
    marked = total_before(marked, keys, order, F.col("_open").cast("int"), "_g").withColumn("_g", F.col("_g") + F.col("_open").cast("int")).where("_g > 0")
    least = F.struct(*order)
    results = marked.groupBy(*keys, "_g").agg(F.min_by(F.when(F.col("_close"), F.col(value)), F.when(F.col("_close"), least)).alias("result"))
    return marked.where("_open").join(results, [*keys, "_g"]).drop("_open", "_close", "_g")


def in_ranges(points: DataFrame, ranges: DataFrame, keys, point: str, low: str, high: str, width: float = 1) -> DataFrame:
    """Range join: points within [low, high] of the same keys; ranges may overlap, and be of any number and length.

    A range is the least set of dyadic intervals of cells (of ``width``) that covers it, two of each size at most, and a
    point is in one interval of each size, so an equi-join on size and interval finds the pairs; only in the
    first and last cell of a range can it find others, which are left out (with whole numbers and cells of 1: none).
    Of the sizes only those that the ranges have are looked up. Rows with a null or infinite place are in no range.
    """
    keys, cell = _cols(keys), lambda c: F.floor(F.col(c) / width)
    real = lambda c: F.abs(F.col(c)) < F.lit(2.0**62 * width)

    def dyadic(first: Column, end: Column) -> Column:
        """(size, interval) of the cells from ``first`` until before ``end``."""

        def of_size(k: Column) -> Column:
            bits = F.call_function("shiftleft", F.lit(1).cast("long"), k)
            a, b = -F.call_function("shiftright", -first, k), F.call_function("shiftright", end, k)
            here = lambda hit, at: F.when((a < b) & hit, F.struct(k.alias("_k"), at.alias("_c")))
            odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1
            return F.when(bits <= end - first, F.array_compact(F.array(here(odd(a), a), here(odd(b), b - 1)))).otherwise(F.array().cast("array<struct<_k:int,_c:bigint>>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), of_size))

    cut = ranges.where(real(low) & real(high) & (F.col(low) <= F.col(high)))
    cut = cut.withColumn("_i", F.explode(dyadic(cell(low), cell(high) + 1))).select("*", "_i._k", "_i._c").drop("_i")
    sizes = sorted(r[0] for r in cut.select("_k").distinct().collect())  # 63 at most
    sizes_of = F.array(*[F.lit(k).cast("int") for k in sizes]).cast("array<int>")
    at = points.where(real(point)).withColumn("_k", F.explode(sizes_of)).withColumn("_c", F.call_function("shiftright", cell(point), F.col("_k")))
    return at.join(cut, [*keys, "_k", "_c"]).where(F.col(point).between(F.col(low), F.col(high))).drop("_k", "_c")


def in_last_range(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """Range join for ranges of one key that don't overlap, on whole numbers: points and ranges in one order, and each range carried on to its points.

    Linear in both, no pair outside a range is formed, and a key's rows are dealt over spans. Overlapping ranges: ``in_ranges``.
    """
    own = [c for c in ranges.columns if c != key]
    starts = ranges.select(key, (2 * F.col(low)).cast("long").alias("_at"), F.struct(*own).alias("_r"), F.lit(None).cast(points.select(F.struct(*[c for c in points.columns if c != key])).schema[0].dataType).alias("_p"))
    places = points.select(key, (2 * F.col(point) + 1).cast("long").alias("_at"), F.lit(None).cast(starts.schema["_r"].dataType).alias("_r"), F.struct(*[c for c in points.columns if c != key]).alias("_p"))
    both = scanned(starts.unionByName(places), key, "_at", lasts={"_in": F.col("_r")}, span=2 * SPAN)
    found = both.where(F.col("_p").isNotNull() & (F.col(f"_p.{point}") <= F.col(f"_in.{high}")))
    return found.select(key, "_p.*", "_in.*")


def range_slice(points: DataFrame, ranges: DataFrame, keys, point: str, low: str, high: str, number: str, wanted: int) -> DataFrame:
    """The points within the ranges of a number; an unknown number is an error that names the known ones.

    The ranges of that number are found once, as a table, however often they are looked at.
    """
    found = stored(ranges.where(F.col(number) == wanted))
    if found.isEmpty():
        known = ", ".join(str(r[0]) for r in ranges.select(number).distinct().orderBy(number).limit(100).collect())
        raise ValueError(f"no {number} {wanted}; there are: {known}")
    return in_ranges(points, found.hint("merge"), keys, point, low, high)  # by its file's size alone, a plan may broadcast any number of ranges


# -- differences -------------------------------------------------------------------------------
def ab_counts(df: DataFrame, keys, side: Column, n: Column | None = None) -> DataFrame:
    """Counts per key on side a (``side`` true) and b, 0 where missing, and their difference; one shuffle."""
    one = n if n is not None else F.lit(1)
    total = lambda on: F.coalesce(F.sum(F.when(on, one)), F.lit(0)).cast("long")
    out = df.where(side.isNotNull()).groupBy(*_cols(keys)).agg(total(side).alias("a"), total(~side).alias("b"))
    return out.withColumn("delta", F.col("b") - F.col("a"))


def ab_top(counts: DataFrame, keys, k: int, least: int = 0) -> DataFrame:
    """The union of both sides' first k keys, by the larger count, then key; at most k."""
    keys = _cols(keys)
    a = counts.where("a > 0").orderBy(F.desc("a"), *keys).limit(k)
    b = counts.where("b > 0").orderBy(F.desc("b"), *keys).limit(k)
    return a.union(b).distinct().where(F.greatest("a", "b") >= least).orderBy(F.desc(F.greatest("a", "b")), *keys).limit(k)


def share_points(a: Column, a_total: Column, b: Column, b_total: Column) -> Column:
    """Difference of two shares in percentage points; null without either total."""
    return F.round(F.try_divide(b.cast("double") * 100, b_total) - F.try_divide(a.cast("double") * 100, a_total), 6)


# -- runs --------------------------------------------------------------------------------------
STATUSES = ("sat", "unsat", "timeout", "unknown")


def tally(runs: DataFrame, keys, status: str = "status", time: str = "time_s", seed: str = "seed", order: str | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """Runs per key and status (anything else is an error), and the fastest of the first two statuses with its seed.

    Of equal times the first by ``order`` counts (default: the smaller seed).
    """
    kinds = kinds or {s: s for s in STATUSES}
    names = list(kinds)
    best = F.struct(F.col(time).alias("t"), F.col(order or seed).alias("o"), F.col(seed).alias("s"))
    fast = lambda s: F.min(F.when(F.col(status) == kinds[s], best))
    out = runs.groupBy(*_cols(keys)).agg(
        F.count("*").alias("runs"),
        *[F.count_if(F.col(status) == v).alias(f"n_{s}") for s, v in kinds.items()],
        F.count_if(F.coalesce(~F.col(status).isin(*kinds.values()), F.lit(True))).alias("n_error"),
        *[fast(s).alias(f"_{s}") for s in names[:2]],
    )
    return out.select(*_cols(keys), "runs", *[f"n_{s}" for s in names], "n_error", *[c for s in names[:2] for c in (F.col(f"_{s}.t").alias(f"fastest_{s}"), F.col(f"_{s}.s").alias(f"fastest_{s}_seed"))])


def closures(tallied: DataFrame, split: str, solved: Column) -> DataFrame:
    """Per split whether any run closed it."""
    return tallied.groupBy(split).agg(F.max(solved).alias("closed"))


def all_closed(closed: DataFrame) -> DataFrame:
    """One row: splits, how many are closed, and whether all are (without splits: yes)."""
    n = F.count_if(F.coalesce("closed", F.lit(False)))
    return closed.agg(F.count("*").alias("splits"), n.alias("n_closed"), (n == F.count("*")).alias("all_closed"))


def stat_means(values: DataFrame, configs: list[str], key: str = "key", config: str = "config", value: str = "value") -> DataFrame:
    """Mean per statistic, a column per config; with two configs also their percentual difference."""
    out = values.groupBy(key).pivot(config, configs).agg(F.avg(value))
    if len(configs) == 2:
        a, b = (F.col(f"`{c}`") for c in configs)
        out = out.withColumn("diff_pct", F.when(a != 0, (b - a) / F.abs(a) * 100))
    return out


def by_magnitude(means: DataFrame, configs: list[str], top: int | None = None, order: str = "magnitude", key: str = "key") -> DataFrame:
    """Statistics by falling largest mean (or, ``order`` "key", by name), the first ``top`` of them."""
    largest = F.coalesce(F.greatest(*[F.abs(F.coalesce(F.col(f"`{c}`"), F.lit(0.0))) for c in configs]), F.lit(0.0)) if len(configs) > 1 else F.abs(F.col(f"`{configs[0]}`"))
    ranked = means.orderBy(*([F.desc(largest)] if order == "magnitude" else []), key)
    return ranked if top is None else ranked.limit(top)


def run_matrix(runs: DataFrame, seeds: list[int], order: str, config: str = "config", seed: str = "seed", status: str = "status", solved=("sat", "unsat")) -> DataFrame:
    """A row per config: the status of each seed's first run by ``order``, and how many runs were solved."""
    cells = runs.groupBy(config).pivot(seed, seeds).agg(F.min_by(status, order))
    count = runs.groupBy(config).agg(F.count_if(F.col(status).isin(*solved)).alias("solved"))
    return cells.join(count, config)


def preview(df: DataFrame, order, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``, each with how many more there are."""
    every = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return df.orderBy(*_cols(order)).limit(n).crossJoin(F.broadcast(every))


def grid(*frames: DataFrame) -> DataFrame:
    """Every combination of rows of small parameter tables."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))
    return out
