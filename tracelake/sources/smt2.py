"""Formulas as tables: an S-expression reader that shares equal subterms.

A file of any size is read by many tasks. Its lines lie in spans; each span is gone through from every state that it may
begin in (plain, inside a string, inside a quoted symbol), the spans' outcomes are put one after the other, and with
state and depth known each span is cut where a top-level form begins. Forms are parsed by themselves, given the
file's definitions. A node's id is a hash of its head and its arguments' ids, so equal terms of different
forms are one node wherever they were parsed; its second half guards against two terms of one id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources.results import stored
from tracelake.sources.trace import lines_of

#: A node as it is parsed: ``check`` guards its id, ``printed`` is a hash of its whole print. Kind Declared: a constant's sort.
PARSED = (
    "file string, id long, head string, kind string, sort string, arity int, num_value string, depth int, root boolean, "
    "children array<long>, check long, printed long"
)
NODE = ("file", "id", "head", "kind", "sort", "arity", "num_value", "depth", "root", "printed")
#: Lines of a span, and characters of definitions that are broadcast at most.
SPAN, GIVEN = 4096, 32 << 20
#: The modulus and base of prints' hashes.
PRIME, BASE = (1 << 61) - 1, 0x1E3779B97F4A7C15 % ((1 << 61) - 1)
_TOKEN = re.compile(r';[^\n]*|"(?:[^"]|"")*"|\|[^|]*\||[()]|[^\s()"|;]+')
_NUMBER = re.compile(r"-?\d+(?:\.\d+|/\d+)?|#b[01]+|#x[0-9a-fA-F]+")
_BOOL = {"and", "or", "not", "=>", "xor", "=", "distinct", "<", "<=", ">", ">=", "true", "false"}


def parse(text: str) -> list:
    """Nested lists of tokens; comments are left out; unbalanced text is an error."""
    stack: list[list] = [[]]
    for token in _TOKEN.findall(text):
        if token[0] == ";":
            continue
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) == 1:
                raise ValueError("unbalanced )")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(token)
    if len(stack) > 1:
        raise ValueError("unbalanced (")
    return stack[0]


class Dag:
    """Hash-consed terms of a text's assertions; ``sort`` tells what a constant's sort is called where it isn't declared in the text."""

    def __init__(self, text: str, sort=lambda _: "?"):
        self.undeclared = sort
        self.ids: dict = {}
        self.nodes: list[dict] = []
        self.edges: list[tuple[int, int, int]] = []
        self.sorts: dict[str, str] = {}
        self.macros: dict[str, tuple[list[str], object]] = {}
        for form in parse(text):
            self.take(form)

    def take(self, form) -> None:
        if form[:1] == ["define-fun"]:
            self.macros[form[1]] = [p[0] for p in form[2]], form[4]
        elif form[:1] == ["define-const"]:
            self.macros[form[1]] = [], form[3]
        elif form[:1] in (["declare-const"], ["declare-fun"]):
            self.sorts[form[1]] = form[-1] if isinstance(form[-1], str) else " ".join(map(str, form[-1]))
        elif form[:1] == ["assert"]:
            self.nodes[self.term(form[1], {})]["root"] = True

    def node(self, head: str, args: tuple[int, ...]) -> int:
        number = not args and _NUMBER.fullmatch(head)
        if number and ("." in head or "/" in head):  # one form for each value
            exact = Fraction(head)
            head = f"{exact}.0" if exact.denominator == 1 else str(exact)
        if (head, args) in self.ids:
            return self.ids[head, args]
        value = None
        if number:
            value = str(int(head[2:], 2 if head[1] == "b" else 16) if head[0] == "#" else Fraction(head))
        if number:
            kind, sort = "Numeral", "BitVec" if head[0] == "#" else "Real" if "." in head or "/" in head else "Int"
        elif head in ("true", "false"):
            kind, sort = head.capitalize(), "Bool"
        elif not args:
            kind, sort = "Var", self.sorts.get(head) or self.undeclared(head)
        else:
            kind = "Op"
            sort = "Bool" if head in _BOOL else self.nodes[args[1]]["sort"] if head in ("ite", "if") and len(args) > 1 else self.sorts.get(head, self.nodes[args[0]]["sort"])
        i = self.ids[head, args] = len(self.nodes)
        depth = 1 + max((self.nodes[a]["depth"] for a in args), default=0)
        self.nodes.append({"id": i, "head": head, "kind": kind, "sort": sort, "arity": len(args), "num_value": value, "depth": depth, "root": False, "children": args})
        self.edges += [(i, pos, a) for pos, a in enumerate(args)]
        return i

    def folded(self, head: str, args: tuple[int, ...]) -> tuple[str, tuple[int, ...]]:
        """A negated numeral and a quotient of two of them are numerals themselves."""
        given = [self.nodes[a] for a in args]
        if all(x["kind"] == "Numeral" and x["head"][0] != "#" for x in given):
            if head == "-" and len(args) == 1 and not given[0]["head"].startswith("-"):
                return "-" + given[0]["head"], ()
            if head == "/" and len(args) == 2 and given[1]["num_value"] != "0":
                exact = Fraction(given[0]["num_value"]) / Fraction(given[1]["num_value"])
                return f"{exact.numerator}/{exact.denominator}", ()
        return head, args

    def term(self, form, bound: dict) -> int:
        """A term's node, definitions put in; without recursion, so depth is bounded by memory only."""
        done: list[int] = []
        work: list = [("eval", form, bound)]
        while work:
            step, form, scope = work.pop()
            if step == "make":
                head, n = form
                args = tuple(done[len(done) - n :])
                del done[len(done) - n :]
                done.append(self.node(*self.folded(head, args)))
            elif step == "macro":
                names, body = form
                values = done[len(done) - len(names) :]
                del done[len(done) - len(names) :]
                work.append(("eval", body, dict(zip(names, values, strict=True))))
            elif step == "let":
                names, body = form
                values = done[len(done) - len(names) :]
                del done[len(done) - len(names) :]
                work.append(("eval", body, scope | dict(zip(names, values, strict=True))))
            elif isinstance(form, str) and form in self.macros and form not in scope:
                work.append(("macro", self.macros[form], scope))
            elif isinstance(form, str):
                done.append(scope[form] if form in scope else self.node(form, ()))
            elif form and isinstance(form[0], str) and form[0] in self.macros:
                names, body = self.macros[form[0]]
                work.append(("macro", (names, body), scope))
                work += [("eval", x, scope) for x in reversed(form[1:])]
            elif form and form[0] == "let":
                work.append(("let", ([b[0] for b in form[1]], form[2]), scope))
                work += [("eval", b[1], scope) for b in reversed(form[1])]
            elif form and form[0] == "!":
                work.append(("eval", form[1], scope))
            else:
                head = form[0] if isinstance(form[0], str) else "(" + " ".join(map(str, form[0])) + ")"
                work.append(("make", (head, len(form) - 1), scope))
                work += [("eval", x, scope) for x in reversed(form[1:])]
        return done[0]


class Scan:
    """What a piece of text does to a reader in each of its states."""

    PLAIN, STRING, QUOTED = range(3)
    _MARK = re.compile(r";[^\n]*|[\"|()]")
    _END = {STRING: '"', QUOTED: "|"}

    @classmethod
    def marks(cls, text: str, state: int) -> Iterator[tuple[int, int]]:
        """(place, +1 or -1) of each bracket that counts; last (-1, the state at the end)."""
        at = 0
        while True:
            if state != cls.PLAIN:
                at = text.find(cls._END[state], at) + 1
                if not at:
                    break
                state = cls.PLAIN
            for m in cls._MARK.finditer(text, at):
                c = m[0]
                if c == "(":
                    yield m.start(), 1
                elif c == ")":
                    yield m.start(), -1
                elif c[0] != ";":
                    state, at = (cls.STRING if c == '"' else cls.QUOTED), m.end()
                    break
            else:
                break
        yield -1, state

    @classmethod
    def outcome(cls, text: str, state: int) -> tuple[int, int, int]:
        """The state at the end, how the depth changes, and how far it falls at most."""
        depth = low = 0
        for place, step in cls.marks(text, state):
            if place < 0:
                return step, depth, low
            depth += step
            low = min(low, depth)
        raise AssertionError


def _spans(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[dict, str]]:
    """(first row, text) of the runs of equal (file, _span) of sorted rows of lines."""
    head, lines = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if head and (row["file"], row["_span"]) != (head["file"], head["_span"]):
                yield head, "\n".join(lines) + "\n"
                head, lines = None, []
            head = head or row
            lines.append(row["line"])
    if head:
        yield head, "\n".join(lines) + "\n"


def _table(rows: list[dict], names: tuple[str, ...], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], list(names))


def forms(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """file, form (by their order in the file), text of the top-level forms of numbered lines (file, line_number, line); unbalanced files are an error."""
    dealt = lines.withColumn("_span", F.floor(F.col("line_number") / span)).repartition("file", "_span").sortWithinPartitions("file", "_span", "line_number")
    dealt = dealt.select("file", "_span", "line_number", "line")
    number, text = pa.int64(), pa.string()

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, block in _spans(batches):
            found = [Scan.outcome(block, state) for state in range(3)]
            row = {"file": head["file"], "_span": head["_span"], "ends": [x[0] for x in found], "change": [x[1] for x in found], "low": [x[2] for x in found]}
            yield _table([row], ("file", "_span", "ends", "change", "low"), (text, number, *[pa.list_(number)] * 3))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state, depth = None, 0, 0

        def ended():
            if depth or state:
                raise ValueError(f"unbalanced ( or quote in {file}")

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    ended()
                    file, state, depth = row["file"], 0, 0
                out.append({"file": file, "_span": row["_span"], "_state": state, "_depth": depth})
                if depth + row["low"][state] < 0:
                    raise ValueError(f"unbalanced ) in {file}")
                depth, state = depth + row["change"][state], row["ends"][state]
            yield _table(out, ("file", "_span", "_state", "_depth"), (text, number, number, number))
        ended()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A form's pieces: ``form`` is where it begins, null for one that an earlier span began."""
        for head, block in _spans(batches):
            depth, start, form, out = head["_depth"], 0, None, []
            base = {"file": head["file"], "_span": head["_span"]}
            for place, step in Scan.marks(block, head["_state"]):
                if place < 0:
                    break
                if not depth and step > 0:
                    start, form = place, (head["_span"] << 32) + place
                depth += step
                if not depth:
                    out.append(base | {"form": form, "piece": block[start : place + 1]})
            if depth:
                out.append(base | {"form": form, "piece": block[start:]})
            if out:
                yield _table(out, ("file", "_span", "form", "piece"), (text, number, number, text))

    before = dealt.mapInArrow(outcomes, "file string, _span long, ends array<long>, change array<long>, low array<long>")
    before = before.repartition("file").sortWithinPartitions("file", "_span").mapInArrow(states, "file string, _span long, _state long, _depth long")
    known = dealt.join(before, ["file", "_span"]).sortWithinPartitions("file", "_span", "line_number")
    cut = known.select("file", "_span", "line", "_state", "_depth").mapInArrow(pieces, "file string, _span long, form long, piece string")
    # A span's first piece may go on from the last form that an earlier span began.
    last = cut.groupBy("file", "_span").agg(F.max("form").alias("_last"))
    earlier = Window.partitionBy("file").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "_span", F.last("_last", ignorenulls=True).over(earlier).alias("_open"))
    open_ = cut.where("form is null").join(last, ["file", "_span"]).select("file", "_span", F.col("_open").alias("form"), "piece")
    begun = cut.where("form is not null").groupBy("file", "form").agg(F.first("_span").alias("_span"), F.first("piece").alias("piece"))
    rest = open_.groupBy("file", "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_span", "piece"))), lambda x: x["piece"]), "").alias("rest"))
    return begun.join(rest, ["file", "form"], "left").select("file", "form", F.concat("piece", F.coalesce("rest", F.lit(""))).alias("text"))


def _hashes(dag: Dag) -> None:
    """id, check and printed of every node, arguments first; what was an index becomes an id."""
    sizes: list[int] = []
    prints: list[int] = []
    for n in dag.nodes:
        args = n["children"]
        key = n["head"].encode() + b"\0" + b"".join(dag.nodes[a]["key"] for a in args)
        n["key"] = hashlib.blake2b(key, digest_size=16).digest()
        n["id"], n["check"] = (int.from_bytes(n["key"][i : i + 8], "little", signed=True) for i in (0, 8))
        parts = [n["head"]] if not args else ["(" + n["head"], *[x for a in args for x in (" ", a)], ")"]
        value = size = 0
        for part in parts:  # the hash of a text end to end follows from its parts' hashes and sizes
            if isinstance(part, str):
                raw = part.encode()
                own, many = 0, len(raw)
                for b in raw:
                    own = (own * BASE + b + 1) % PRIME
            else:
                own, many = prints[part], sizes[part]
            value, size = (value * pow(BASE, many, PRIME) + own) % PRIME, (size + many) % (PRIME - 1)
        prints.append(value)
        sizes.append(size)
        n["printed"] = value
    for n in dag.nodes:
        n["children"] = [dag.nodes[a]["id"] for a in n["children"]]


def _parsed(found: DataFrame, show: int | None = None) -> DataFrame:
    """PARSED rows (with ``show`` file, id, text rows) of forms, each parsed by itself with its file's definitions."""
    spark = found.sparkSession
    is_definition = F.col("text").rlike(r"^\(\s*define-(fun|const)\b") | F.col("text").rlike(r"^\(\s*declare-fun\s+\S+\s+\(\s*[^\s)]")
    definitions = found.where(is_definition)
    listed = definitions.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("form", "text"))), lambda x: x["text"]).alias("defs"))
    size = definitions.agg(F.sum(F.length("text"))).first()[0] or 0
    held = {r["file"]: list(r["defs"]) for r in listed.collect()} if size <= GIVEN else None
    given = spark.sparkContext.broadcast(held)
    wanted = found.where(~is_definition).select("file", "text", F.array().cast("array<string>").alias("defs"))
    if held is None:  # too many for every task: each form gets its file's
        wanted = found.where(~is_definition).select("file", "text").join(listed, "file", "left")
    fields = [f.rsplit(" ", 1) for f in PARSED.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    names, types = tuple(n for n, _ in fields), tuple(kinds[k] for _, k in fields)

    def parse_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None, None)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                defs = given.value.get(row["file"], []) if given.value is not None else row["defs"] or []
                if last[0] != row["file"] or last[1] != len(defs):
                    base = Dag(" ".join(defs))
                    last = row["file"], len(defs), base
                dag = Dag("", sort=lambda name: f"?{name}")
                dag.sorts, dag.macros = dict(last[2].sorts), last[2].macros
                constants = set()
                for form in parse(row["text"]):
                    if form[:1] in (["declare-const"], ["declare-fun"]):
                        constants.add(form[1])
                    dag.take(form)
                if show is None:
                    _hashes(dag)
                    out += [{"file": row["file"]} | n for n in dag.nodes]
                    out += [{c: None for c in names} | {"file": row["file"], "head": c, "kind": "Declared", "sort": dag.sorts[c]} for c in constants]
                else:
                    _hashes(dag)
                    out += [{"file": row["file"], "id": i, "text": t} for i, t in _shown(dag, show)]
            if show is None:
                yield _table(out, names, types)
            else:
                yield _table(out, ("file", "id", "text"), (pa.string(), pa.int64(), pa.string()))

    return wanted.mapInArrow(parse_forms, PARSED if show is None else "file string, id long, text string")


def _shown(dag: Dag, most: int) -> Iterator[tuple[int, str]]:
    """Every node's id and print, cut to ``most`` characters."""
    text: dict[int, str] = {}
    for n in dag.nodes:
        full = f"({n['head']} {' '.join(text[c] for c in n['children'])})" if n["children"] else n["head"]
        text[n["id"]] = full if len(full) <= most else full[: most - 3] + "..."
    yield from text.items()


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file", F.posexplode(F.split("text", "\n", -1)).alias("line_number", "line")).withColumn("line_number", F.col("line_number").cast("long"))


def read_smt2(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of every file's assertions; a large file is read by many tasks."""
    return dag_of_lines(lines_of(spark, path).withColumnRenamed("trace_id", "file"))


def dag_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a table (file, text)."""
    return dag_of_lines(_lines(files))


def dag_of_lines(lines: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of numbered lines (file, line_number, line). Forms are parsed once, and equal terms of a file are one node."""
    found = _parsed(forms(lines, span))
    same = lambda c: F.first(c).alias(c)
    nodes = found.where("kind <> 'Declared'").groupBy("file", "id").agg(
        *[same(c) for c in ("head", "kind", "sort", "arity", "num_value", "depth", "children", "printed")], F.max("root").alias("root"), F.min("check").alias("_a"), F.max("check").alias("_b")
    )
    declared = found.where("kind = 'Declared'").groupBy("file", F.concat(F.lit("?"), "head").alias("sort")).agg(F.first("sort").alias("_sort"))
    nodes = nodes.join(declared, ["file", "sort"], "left")
    # A sort that starts with ? is that of a constant which another form declares.
    sort = F.when(F.col("sort").startswith("?"), F.coalesce("_sort", F.lit("?"))).otherwise(F.col("sort"))
    clash = F.when(F.col("_a") != F.col("_b"), F.raise_error(F.lit("two terms have one id")))
    nodes = nodes.withColumn("sort", sort).withColumn("id", F.coalesce(clash.cast("long"), "id")).drop("_sort", "_a", "_b")
    nodes = stored(nodes)
    edges = nodes.select("file", F.col("id").alias("parent"), F.posexplode("children").alias("pos", "child"))
    return nodes.select(*NODE), edges


def term_texts(files: DataFrame, most: int = 10_000) -> DataFrame:
    """(file, id, text): every node of a table (file, text) printed; a text of more than ``most`` characters is cut, with ... at its end."""
    return _parsed(forms(_lines(files)), most).dropDuplicates(["file", "id"])
