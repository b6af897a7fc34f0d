"""Each stage of the corpus pipeline against a brute-force version, each on its own input."""

import collections
import re

import pytest

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each one, by doc_id."""
    import corpus_pipeline
    from tracelake.llm.common import durable

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, SF))
        seen.append(docs.collect())
    return seen


def by_id(rows):
    return {r.doc_id: r for r in rows}


def shingles(text):
    low = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))} if low else set()


def test_quality_keeps_good_documents(spark, stages):
    from tracelake.llm.quality import score_quality

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = score_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    assert set(by_id(stages[1])) == {r.doc_id for r in scored if r.predicted == 1}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(by_id(stages[0]))
    assert len(good & set(by_id(stages[1]))) >= 0.9 * len(good)


def test_stages_decide_by_row(spark):
    """Rows whose id is null or repeated."""
    import corpus_pipeline as c
    from tracelake.llm.quality import score_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    say = lambda k: " ".join(f"w{k}x{i * i % 1009}" for i in range(60))
    rows = [(1, say(1)), (1, say(1)), (1, say(2)), (None, say(1)), (None, say(3)), (4, say(2) + " end"), (None, None), (6, None)]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    key = lambda rows: sorted((r.doc_id or -1, r.text or "") for r in rows)
    want = [(1, say(1)), (1, say(2)), (-1, say(3)), (-1, ""), (6, "")]
    assert key(c.ngram_jaccard_join(spark, frame(rows), SF).collect()) == sorted(want)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    rows = [(None, "so " + item), (7, "so " + item), (7, say(7)), (None, say(8))]
    assert key(c.benchmark_decontamination(spark, docs.unionByName(frame(rows)), SF).where("doc_id is null or lang = 'en' and source = 's'").collect()) == sorted([(7, say(7)), (-1, say(8))])
    scored = score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("score < 0.2 or score > 0.4").collect()
    texts, verdict = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.predicted for r in scored}
    bad, good = (next(texts[d] for d in verdict if verdict[d] == v and texts[d]) for v in (0, 1))
    rows = [(None, bad), (9999, good), (9999, bad), (None, good)]
    found = c.quality_classifier(spark, docs.unionByName(frame(rows)), SF).where("source = 's'").collect()
    assert key(found) == sorted([(9999, good), (-1, good)])


def test_line_dedup_equals_brute_force(stages):
    pages, holds = collections.defaultdict(set), collections.defaultdict(set)
    for r in stages[1]:
        if r.text is not None:
            pages[r.source or ""].add(r.text)
            for line in r.text.split("\n"):
                holds[r.source or "", line.strip(" ")].add(r.text)

    def kept(r):
        bad = lambda x: x and len(holds[r.source or "", x]) >= 3 and len(holds[r.source or "", x]) > 0.05 * len(pages[r.source or ""])
        return None if r.text is None else "\n".join(x for x in r.text.split("\n") if not bad(x.strip(" ")))

    assert {r.doc_id: r.text for r in stages[2]} == {r.doc_id: kept(r) for r in stages[1]}


def test_one_document_of_each_component_stays(stages):
    sets = {r.doc_id: shingles(r.text) for r in stages[2]}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert set(by_id(stages[3])) == {d for d in sets if top(d) == d}


def test_benchmark_passages_go_and_others_stay(spark, stages):
    from tracelake.llm.decontaminate import common

    items = [WORDS.findall(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").collect()]
    left = set(by_id(stages[4]))
    for r in stages[3]:
        low = WORDS.findall((r.text or "").lower())
        whole = any(" ".join(i) in " ".join(low) for i in items if len(i) >= 8)
        assert not (whole and r.doc_id in left)
        if r.doc_id not in left:
            assert any(common(i, low) >= 0.5 * len(i) for i in items)


def test_packing_holds_every_piece_once(stages):
    assert {r.doc_id for r in stages[5]} == set(by_id(stages[4]))
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in stages[5]:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    for found in pieces.values():
        assert [(p, s) for p, s, _ in sorted(found)] == [(k, k * 4096) for k in range(len(found))]
    total = sum(r.length for r in stages[5])
    assert len(bins) <= -(-total // 4096) + 1


def test_stages_take_odd_and_empty_tables(spark):
    """Null texts, a null in any column, no rows; and the tables of a stage go with it."""
    import os

    import corpus_pipeline as c
    from tracelake.llm import common

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in c.STAGES:
            found = common.kept(spark, lambda stage=stage, docs=docs: stage(spark, docs, SF))
            ids = {r.doc_id for r in found.select("doc_id").collect()}
            assert ids <= {r[0] for r in rows}
            if name in ("line_dedup", "benchmark_decontamination", "best_fit_packing"):
                assert ids == {r.doc_id for r in docs.select("doc_id").collect()}
            if name != "best_fit_packing":
                docs = found
    where = f"{spark.conf.get('spark.checkpoint.dir')}/tracelake"
    before = set(os.listdir(where))
    common.kept(spark, lambda: common.durable(common.durable(spark.range(5))))
    assert len(set(os.listdir(where)) - before) == 1


def test_stages_keep_all_columns(spark):
    """Columns beside the five of the table, some of them named as those that stages make; long, empty and null texts."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "long word " * 60_000, "en", "s", 0), (-2, "", "en", "s", 0), (-3, None, None, None, None)], docs.schema)
    docs = docs.unionByName(odd).selectExpr("*", "'mine' AS _row", "doc_id + 1 AS score", "1 AS component_id", "'x' AS row")
    for _, stage in c.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        assert {(r["_row"], r["component_id"], r["row"]) for r in found.collect()} == {("mine", 1, "x")} and found.where("score <> doc_id + 1").isEmpty()
    assert c.STAGES[-1][1](spark, docs, SF).where("doc_id = -1").count() > 1


def test_kept_deletes_its_own_tables_only(spark):
    import threading

    from tracelake.llm.common import durable, kept

    started, go, found = threading.Event(), threading.Event(), {}

    def other():
        found["other"] = durable(spark.range(7))
        started.set()
        go.wait(60)

    thread = threading.Thread(target=other)

    def make():
        inner = kept(spark, lambda: durable(spark.range(3)).join(durable(spark.range(2)), "id"))
        thread.start()
        assert started.wait(60)
        return inner.union(inner)

    result = kept(spark, make)
    go.set()
    thread.join()
    assert result.count() == 4 and found["other"].count() == 7
