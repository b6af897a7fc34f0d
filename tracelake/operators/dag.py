"""Tree patterns over expression graphs (nodes, edges), compiled to equi-joins; summaries and splits.

Pattern language: _ any term; ?x a capture (equal names: the same node); :T or ?x:T a type among
Bool, Numeral, Var, Expr, Eq, Comparison, negated by !; an integer; a name; (head arg ...).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type names of patterns, what counts as a comparison, alias of a head, patterns that a summary counts.
TYPES = ("Bool", "Numeral", "Var", "Expr", "Eq", "Comparison")
COMPARISONS = ("<", "<=", ">", ">=")
ALIASES = {"if": "ite"}
SHAPES = ("(div ?a ?b)", "(mod ?a ?b)", "(ite ?c ?a ?b)", "(div (ite ?c ?a ?b) ?k)", "(mod (ite ?c ?a ?b) ?k)", "(* ?x (ite ?c ?a ?b))", "(* (ite ?c ?a ?b) ?x)")


class PatternError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    """One place of a pattern: any of capture, type test, numeral, or a head with arguments."""

    capture: str | None = None
    type: str | None = None
    negated: bool = False
    number: str | None = None
    head: str | None = None
    args: tuple[Term, ...] = ()


def parse_pattern(text: str) -> Term:
    tokens = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def term() -> Term:
        nonlocal at
        if at == len(tokens):
            raise PatternError("the pattern ends early")
        token = tokens[at]
        at += 1
        if token == ")":
            raise PatternError("unexpected )")
        if token != "(":
            return _atom(token)
        if at == len(tokens) or tokens[at] in "()":
            raise PatternError("a head is expected after (")
        head = tokens[at]
        at += 1
        args = []
        while at < len(tokens) and tokens[at] != ")":
            args.append(term())
        if at == len(tokens):
            raise PatternError("a ) is missing")
        at += 1
        if not args:
            raise PatternError(f"({head}) has no arguments")
        return Term(head=ALIASES.get(head, head), args=tuple(args))

    found = term()
    if at < len(tokens):
        raise PatternError(f"unexpected {tokens[at]!r}")
    return found


def _atom(token: str) -> Term:
    if token == "_":
        return Term()
    if m := re.fullmatch(r"(!?)(?:\?(\w+))?(?::(!?)(\w+))?", token):
        before, name, after, kind = m.groups()
        if name or kind:
            if kind and kind not in TYPES:
                raise PatternError(f"unknown type {kind!r}")
            if before and not kind:
                raise PatternError("! needs a type")
            return Term(capture=name, type=kind, negated=bool(before) != bool(after))
    if token[0] in "?:!":
        raise PatternError(f"can't read {token!r}")
    return Term(number=token) if re.fullmatch(r"-?\d+", token) else Term(head=token)


def _fits(t: Term, n: str) -> Column:
    c = lambda x: F.col(f"{n}.{x}")
    test = F.lit(True)
    if t.type:
        test = {"Bool": c("sort") == "Bool", "Numeral": c("kind") == "Numeral", "Var": c("kind") == "Var", "Expr": F.lit(True), "Eq": (c("head") == "=") & (c("arity") > 0), "Comparison": c("head").isin(*COMPARISONS) & (c("arity") > 0)}[t.type]
        test = ~test if t.negated else test
    if t.number is not None:
        test &= c("num_value") == str(int(t.number))
    if t.head is not None:
        head = F.when(c("head") == "if", "ite").otherwise(c("head"))
        test &= (head == t.head) & (c("arity") == len(t.args))
    return F.coalesce(test, F.lit(False))


def find(nodes: DataFrame, edges: DataFrame, pattern: str | Term) -> DataFrame:
    """file, id and the captures' node ids of every node that matches."""
    top = parse_pattern(pattern) if isinstance(pattern, str) else pattern
    n = 0
    found = nodes.alias("n0").where(_fits(top, "n0")).select(F.col("n0.file").alias("file"), F.col("n0.id").alias("id"), F.col("n0.id").alias("p0"))
    captures: dict[str, str] = {}
    work = [(top, "p0")]
    while work:
        t, place = work.pop(0)
        if t.capture:
            if t.capture in captures:
                found = found.where(F.col(captures[t.capture]) == F.col(place))
            else:
                captures[t.capture] = place
        for pos, arg in enumerate(t.args):
            n += 1
            step = edges.where(F.col("pos") == pos).select("file", F.col("parent").alias(place), F.col("child").alias(f"p{n}"))
            found = found.join(step, ["file", place])
            if arg.type or arg.number is not None or arg.head is not None:
                ok = nodes.alias("x").where(_fits(arg, "x")).select("file", F.col("id").alias(f"p{n}"))
                found = found.join(ok, ["file", f"p{n}"], "left_semi")
            work.append((arg, f"p{n}"))
    return found.select("file", "id", *[F.col(p).alias(c) for c, p in captures.items()])


def distinct_matches(found: DataFrame, nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Of a file's matches the first (smallest id) of each print, told apart by the hash of the whole print; with ``texts`` also shown."""
    first = found.join(nodes.select("file", "id", "printed"), ["file", "id"]).groupBy("file", "printed")
    least = first.agg(F.min(F.struct("id", *[c for c in found.columns if c not in ("file", "id")])).alias("_m")).select("file", "_m.*")
    return least if texts is None else least.join(texts, ["file", "id"])


def parse_tactic(text: str) -> list[str]:
    """NAME or (then NAME ...) as the names in order; nothing else is a tactic."""
    tokens = re.findall(r"[()]|[^\s()]+", text)
    if len(tokens) == 1 and tokens[0] not in "()":
        return tokens
    if len(tokens) < 4 or tokens[:2] != ["(", "then"] or tokens[-1] != ")":
        raise PatternError(f"not a name or (then name ...): {text!r}")
    names = tokens[2:-1]
    if "(" in names or ")" in names:
        raise PatternError(f"tactics can't be nested: {text!r}")
    return names


def kind_text(nodes: DataFrame) -> DataFrame:
    text = F.when(F.col("kind") == "Numeral", F.concat(F.lit("Numeral("), "num_value", F.lit(")"))).when(F.col("kind") == "Var", F.concat(F.lit("Var("), "head", F.lit(")"))).when(F.col("kind") == "Op", F.concat(F.lit("Op("), "head", F.lit(")"))).otherwise(F.col("kind"))
    return nodes.withColumn("description", text)


def summary(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """section, key, n per file: assertions, constants by sort, operators over distinct nodes, greatest depth (of a term without arguments: 0); with ``edges`` also the matches of ``SHAPES``, zeros included."""
    row = lambda df, section, key, n: df.groupBy("file", key.alias("key")).agg(n.cast("long").alias("n")).select("file", F.lit(section).alias("section"), "key", "n")
    out = (
        row(nodes.where("root"), "summary", F.lit("asserts"), F.count("*"))
        .unionByName(row(nodes, "summary", F.lit("max_depth"), F.max("depth") - 1))
        .unionByName(row(nodes.where("kind = 'Var'"), "constants", F.col("sort"), F.count("*")))
        .unionByName(row(nodes.where("kind = 'Op'"), "operators", F.col("head"), F.count("*")))
    )
    for shape in SHAPES if edges is not None else ():
        found = nodes.join(find(nodes, edges, shape).select("file", "id", F.lit(1).alias("hit")), ["file", "id"], "left")
        out = out.unionByName(row(found, "shapes", F.lit(shape), F.count("hit")))
    return out


def summary_diff(a: DataFrame, b: DataFrame, equal: bool = False, by=()) -> DataFrame:
    """Both summaries' rows side by side, for each ``by``; rows that agree only on demand."""
    keys, none = [*by, "section", "key"], F.lit(0).cast("long")
    both = a.select(*keys, F.col("n").alias("a"), none.alias("b")).unionByName(b.select(*keys, none.alias("a"), F.col("n").alias("b")))
    out = both.groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("delta", F.col("b") - F.col("a"))
    return out if equal else out.where("a <> b")


def bool_constants(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Var' and sort = 'Bool'").select("file", "id", F.col("head").alias("name"))


def ite_guards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Plain Boolean constants that guard an ite whose branches differ."""
    ites = find(nodes, edges, "(ite ?g:Var ?t ?e)").where("t <> e").select("file", F.col("g").alias("id")).distinct()
    return bool_constants(nodes).join(ites, ["file", "id"], "left_semi")


def fixed_bools(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Constants that an assertion states or denies."""
    yes = nodes.where("root and kind = 'Var' and sort = 'Bool'").select("file", "id", F.lit(True).alias("value"))
    no = nodes.where("root and head = 'not'").select("file", F.col("id").alias("parent")).join(edges, ["file", "parent"]).select("file", F.col("child").alias("id"), F.lit(False).alias("value"))
    return bool_constants(nodes).join(yes.unionByName(no), ["file", "id"])


def candidates(nodes: DataFrame, edges: DataFrame, pattern: str | None = None, allowed: str | None = None) -> DataFrame:
    """Names to split on: those the pattern finds, then ite guards; fixed ones are out; by origin, then name."""
    named = bool_constants(nodes).where(F.col("name").rlike(pattern)) if pattern else bool_constants(nodes).limit(0)
    both = named.withColumn("origin", F.lit(0)).unionByName(ite_guards(nodes, edges).withColumn("origin", F.lit(1)))
    both = both.join(fixed_bools(nodes, edges), ["file", "id"], "left_anti")
    both = both.where(F.col("name").rlike(allowed)) if allowed else both
    return both.groupBy("file", "id", "name").agg(F.min("origin").alias("origin")).orderBy("file", "origin", "name")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: exprs, ites, divs, mods, products and quotients over an ite, degree (variables multiplied in one product, at most) and whether it is linear."""
    product = nodes.where("head in ('*', 'div', 'mod', '/') and arity > 0").select("file", F.col("id").alias("parent"), F.col("head").alias("of"))
    under = edges.join(product, ["file", "parent"]).join(nodes.select("file", F.col("id").alias("child"), "head", "kind", "arity"), ["file", "child"])
    over = under.where("of <> '/' and head in ('ite', 'if') and arity > 0").groupBy("file").agg(F.countDistinct("parent").alias("over_ite"))
    factors = F.count_if(F.col("kind") != "Numeral")
    each = under.groupBy("file", "parent", "of").agg(factors.alias("factors"), F.max(F.when(F.col("pos") > 0, F.col("kind") != "Numeral")).alias("by_term"))
    degree = F.max(F.when(F.col("of") == "*", F.col("factors")))
    curved = F.max(F.when(F.col("of") == "*", F.col("factors") > 1).otherwise(F.col("by_term")))
    shape = each.groupBy("file").agg(degree.alias("degree"), (~curved).alias("linear"))
    n = lambda *h: F.count_if(F.col("head").isin(*h) & (F.col("arity") > 0))
    out = nodes.groupBy("file").agg(F.count("*").alias("exprs"), n("ite", "if").alias("ites"), n("div").alias("divs"), n("mod").alias("mods"))
    out = out.join(over, "file", "left").join(shape, "file", "left")
    return out.select("file", "exprs", "ites", "divs", "mods", F.coalesce("over_ite", F.lit(0)).alias("over_ite"), F.greatest("degree", F.lit(1)).alias("degree"), F.coalesce("linear", F.lit(True)).alias("linear"))


#: What a fall of each metric by one is worth, and what becoming linear is.
GAIN = {"exprs": 0.1, "ites": 5.0, "degree": 3.0, "divs": 2.0, "mods": 2.0, "over_ite": 5.0, "linear": 50.0}


def gain(before: Column, after: Column, over_ite_weight: float = GAIN["over_ite"]) -> Column:
    """How much smaller a formula's metrics become (structs of what ``metrics`` gives)."""
    weights = {k: w for k, w in GAIN.items() if k != "linear"} | {"over_ite": over_ite_weight}
    falls = sum(((before[k] - after[k]) * w for k, w in weights.items()), F.lit(0.0))
    return (falls + F.when(after["linear"] & ~before["linear"], GAIN["linear"]).otherwise(0.0)).cast("double")


def valuations(names: DataFrame) -> DataFrame:
    """All 2^k leaves of k names (bit i: the i-th name) as maps."""
    listed = names.agg(F.array_sort(F.collect_list("name")).alias("names"))
    leaves = listed.select("names", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), F.size("names")).cast("long") - 1)).alias("leaf"))
    bits = F.transform("names", lambda _, i: F.floor(F.col("leaf") / F.pow(F.lit(2), i)) % 2 == 1)
    return leaves.select("leaf", F.map_from_arrays("names", bits).alias("valuation"))
