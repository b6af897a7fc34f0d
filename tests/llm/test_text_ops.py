"""Toxicity, collocations and fill-in-middle against brute force, on small made-up tables with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tracelake.llm import collocations as c
from tracelake.llm import fill_middle as f
from tracelake.llm import queries
from tracelake.llm import toxicity as t

SF = "/root/testdata/sf0.001"
#: Besides what the operators read, columns with the names of what they return.
DOCS = "doc_id long, text string, lang string, n long, form string, score double, phrase string, rank string"


def rows_of(texts):
    return [(i, x, lang, 7, "form", 0.5, "phrase", "rank") for i, (x, lang) in enumerate(texts)]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sql_rows(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name]).df()[found.columns]
    return sorted(map(repr, (tuple(map(str, r)) for r in found.collect()))), sorted(map(repr, (tuple(map(str, r)) for r in want.astype(object).where(want.notna(), None).itertuples(index=False, name=None))))


# Fill-in-middle


def test_units_and_selection():
    r = random.Random(0)
    for _ in range(400):
        text = "".join(r.choice("abZ éß日1.\n😀 ") for _ in range(r.randint(0, 40)))
        want = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        starts = f.unit_starts(text)
        assert [i for i in range(len(text)) if starts >> i & 1] == want
        assert [f.select(starts, k) for k in range(len(want))] == want


def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or three % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if four % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, empty):
    r = random.Random(1)
    texts = ["".join(r.choice(["word", "Ab", " ", ".", "é", "日本", "\n", "<", ">", "<P", "S>"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "a <M> b", "<P>", "x" * 70_000, "é" * 50_000, "ab, " * 60_000, "\x00\x1c a", "same", "same"]
    rows = rows_of([(x, None) for x in texts])
    rows += [(None, "null key", None, None, None, None, None, None), rows[3]]
    found = f.fill_in_middle(spark.createDataFrame(rows, DOCS).repartition(3))
    found = found.select("*", f.restored(found.output, found.form).alias("restored")).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in found), key=repr) == sorted(((x[0], *fim(x[0], x[1])) for x in rows), key=repr)
    assert {x.form for x in found} == {"plain", "psm", "spm"}
    assert sorted(((x.doc_id, x.restored) for x in found), key=key) == sorted(((x[0], x[1] or "") for x in rows), key=key)
    assert f.fill_in_middle(empty).count() == 0
    found, want = sql_rows(spark, "op13_fill_in_middle")
    assert found == want


# Collocations


def mined(rows, least, cover, top):
    """The contract, word by word."""
    count, n = collections.Counter(), collections.Counter()
    for x in rows:
        lang = "und" if x[2] is None else x[2]
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), x[1] or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                count.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = collections.defaultdict(list)
    for p, a in count.items():
        if len(p) < 3 or a < least:
            continue
        if len(p) == 3 and any(100 * b >= cover * a for q, b in count.items() if len(q) == 4 and b >= least and q[0] == p[0] and p[1:] in (q[1:3], q[2:4])):
            continue
        cuts = [(1_000_000 * a * a // (count[p[: k + 1]] * count[p[:1] + p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        phrase = " ".join(p[1:])
        out[p[0]].append((-score, -a, phrase.encode(), (phrase, a, count[p[: k + 1]], count[p[:1] + p[k + 1 :]], n[p[0]], score)))
    return sorted((lang, i, *x[3]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top], 1))


def spoken(seed=0):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "a", "é", "b\x00c", "x-y", "ß", *(f"w{i}" for i in range(30))]
    say = lambda k: "".join(r.choice(words[: r.choice((3, 8, len(words)))]) + r.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r"]) for _ in range(k))
    texts = [(say(r.randint(0, 60)), r.choice(["en", "de", None, "und"])) for _ in range(120)]
    texts += [("new york city " * 3, "en")] * 40 + [("rare pair here", "fr")] * 10 + [("la la la la la", "fr")] * 5
    return rows_of([*texts, (None, "en"), ("", None), ("...", "en"), ("word " * 5000, "de"), ("z" * 5000, "en")])


@pytest.mark.parametrize(("head_words", "split"), [(c.HEAD, c.SPLIT), (6, c.SPLIT), (c.HEAD, 50), (9, 30), (0, 30)])
def test_collocations(spark, monkeypatch, head_words, split):
    """Also where few words or none are numbered, and where pivots are dealt over several buckets."""
    monkeypatch.setattr(c, "SPLIT", split)
    rows = spoken()
    found = c.collocations(spark.createDataFrame(rows, DOCS).repartition(3), least=5, cover=50, top=40, head_words=head_words, buckets=3)
    assert sorted((x["lang"], x["rank"], x["phrase"], x["a"], x["l"], x["r"], x["n"], x["score"]) for x in found.collect()) == mined(rows, 5, 50, 40)


def test_collocations_of_nothing(spark, empty):
    assert c.collocations(empty).count() == 0
    assert c.collocations(spark.createDataFrame(rows_of([("one two", None), (None, "en")]), DOCS)).count() == 0
    found, want = sql_rows(spark, "op12_collocations")
    assert found == want


def test_each_occurrence_has_one_fragment():
    r = np.random.default_rng(3)
    rank = r.integers(-1, 4, 500)
    piece = np.cumsum(r.random(500) < 0.1)
    columns, _ = c.fragments(rank, piece)
    found = collections.Counter()
    for x, y, z, n in c.phrases(columns):
        found.update({tuple(int(i) for i in w if i != c.NONE): int(k) for *w, k in zip(x, y, z, n, strict=True)})
    want = collections.Counter(
        tuple(rank[i : i + k].tolist()) for k in (2, 3) for i in range(501 - k) if (rank[i : i + k] >= 0).all() and piece[i] == piece[i + k - 1]
    )
    assert found == want


# Toxicity


def labelled(seed=0, n=900):
    r = random.Random(seed)
    plain = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(3, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:  # forms of two stems, most of them seen once
            words.insert(r.randrange(len(words)), r.choice(["grumpfl", "Zwackel"]) + "".join(r.choice("xyzw") for _ in range(3)))
        texts.append((" ".join(words), r.choice(["en", "de", None])))
        labels.append((i, int(toxic), 1))
    return rows_of(texts), labels


def test_toxicity_on_held_out_texts(spark, empty):
    rows, labels = labelled()
    odd = [(2000, None, None), (2001, "", "en"), (2002, "word " * 200_000, "de"), (2003, "...", "xx"), (None, "null key", "en"), (2004, rows[0][1], "en"), (2004, rows[0][1], "en")]
    rows += [(*x, 7, "form", 0.5, "phrase", "rank") for x in odd]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    label_rows = spark.createDataFrame([*labels, (1, None, 1), (None, 1, 1)], "doc_id long, toxic int, score int")
    found = t.score_toxicity(docs, label_rows).collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in found)
    of = {x.doc_id: x for x in found}
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in found)
    held = [(of[i].predicted, toxic) for i, toxic, _ in labels if of[i].held_out]
    assert sum(p for p, toxic in held if toxic) >= 0.9 * sum(toxic for _, toxic in held)
    assert sum(p for p, toxic in held if not toxic) <= 0.02 * len(held)
    assert of[2000].score == of[2001].score == of[2003].score
    # Neither the labels of held-out rows nor anything but the text changes a score; the result is the same each time.
    other = spark.createDataFrame([(i, 1 - x if of[i].held_out else x, 0) for i, x, _ in labels], "doc_id long, toxic int, score int")
    again = t.score_toxicity(docs.repartition(5), other).collect()
    assert {x.doc_id: x.score for x in again} == pytest.approx({x.doc_id: x.score for x in found}, abs=1e-6)
    assert t.score_toxicity(empty, label_rows).count() == 0
    assert len({x.score for x in t.score_toxicity(docs, label_rows.where("false")).collect()}) == 1


def test_thresholds_by_language(spark):
    scored = [("a", 0.9 if i < 30 else 0.1, i < 30) for i in range(100)] + [("b", 0.6 if i < 30 else 0.55, i < 30) for i in range(100)] + [("few", 0.2, True), (None, 0.1, False)]
    found = {x["lang"]: x["threshold"] for x in t.thresholds(spark.createDataFrame(scored, "lang string, score double, toxic boolean")).collect()}
    assert found == {"a": 0.9, "b": 0.6, None: 0.6}


def test_long_texts_are_scored_as_a_whole(monkeypatch):
    r = np.random.default_rng(0)
    net = t.Net.start(r.normal(0, 1, t.NOTHING), 0.1)
    sizes = [0, 1, 2, 900, 0, 3, 4000, 5, 0]
    ids = r.integers(0, t.ROWS, (sum(sizes), len(t.STEMS))).astype("<u2")
    bounds = np.r_[0, np.cumsum(sizes)]
    whole = net.scores(ids, bounds)
    one = np.concatenate([net.scores(ids[a:b], np.array([0, b - a])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    monkeypatch.setattr(t, "PIECE", 64)
    assert np.allclose(whole, net.scores(ids, bounds), atol=1e-6) and np.allclose(whole, one, atol=1e-6)


def test_gradients():
    """The steps' direction against differences of the loss."""
    r = np.random.default_rng(1)
    net = t.Net.start(r.normal(0, 1, t.NOTHING), 0.3)
    ids = r.integers(0, t.ROWS, (60, len(t.STEMS))).astype("<u2")
    bounds, toxic = np.array([0, 10, 10, 35, 60]), np.array([1.0, 0, 0, 1])

    def loss(weights):
        p = t.Net(weights).scores(ids, bounds)
        return -np.mean(toxic * np.log(p) + (1 - toxic) * np.log(1 - p))

    net.bias += 0.02  # away from where the rectifier has no slope, which an empty text meets
    before = [w.astype(float) for w in net.weights]
    net.learn([np.ones(w.shape, "f4") for w in net.weights], ids, bounds, toxic)
    step = [(b - w.astype(float)) / t.RATE for b, w in zip(before, net.weights, strict=True)]  # g / sqrt(1 + g g)
    slopes = [s / np.sqrt(1 - s**2) for s in step]
    for k in (1, 2, 3, 4):
        for at in r.integers(0, before[k].size, 6):
            moved = [w.copy() for w in before]
            moved[k].flat[at] += 1e-4
            up = loss(moved)
            moved[k].flat[at] -= 2e-4
            assert abs((up - loss(moved)) / 2e-4 - slopes[k].flat[at]) < 1e-4 + 0.02 * abs(slopes[k].flat[at])


def test_toxicity_scores_do_not_depend_on_the_texts_around():
    r = np.random.default_rng(1)
    net = t.Net.start(r.uniform(-2, 5, t.NOTHING), 0.1)
    net.words[: t.NOTHING, 1:] *= 10
    exact = net.exact()
    assert max(np.abs(a - b).max() for a, b in zip(net.weights, exact.weights, strict=True)) < 0.01
    sizes = r.integers(0, 9, 300)
    bounds = np.r_[0, np.cumsum(sizes)]
    ids = r.integers(0, t.ROWS, (bounds[-1], len(t.STEMS)))
    whole = exact.scores(ids, bounds)
    assert whole.tolist() == [exact.scores(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert whole == pytest.approx(net.scores(ids, bounds), abs=0.02)


def test_toxicity_arrays_are_added_up_in_tasks(spark):
    """The driver gets one row a piece, however many shards there are."""
    rows = [(s, s * 10 + i) for s in range(7) for i in range(3)]
    sent = []
    frame = type(spark.range(1))
    kept, frame.toArrow = frame.toArrow, lambda df: sent.append(kept(df)) or sent[-1]
    try:
        total = t._summed(spark.createDataFrame(rows, "shard int, x long"), lambda table: np.full(100, sum(table["x"].to_pylist())))
    finally:
        frame.toArrow = kept
    assert total.tolist() == [sum(x for _, x in rows)] * 100 + [7]
    assert [x.num_rows for x in sent] == [t.PIECES]
    assert t._summed(spark.createDataFrame([], "shard int, x long"), len).tolist() == [0]
