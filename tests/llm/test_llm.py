"""The training-data operators against brute force, on small made-up tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, value double"


def made(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared, texts = say(30), []
    for i in range(n):
        texts.append(say(r.randint(1, 120)) if i % 3 else say(40) + " " + shared + " " + say(20))
    for i in range(0, n, 4):
        w = texts[i].split()
        w[r.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [texts[1]] * 9 + ["", None, "   ", "one", "One", "é ü ß", say(3000), "a" * 5000, "x y z\n" * 300]
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "clash", 1.0) for i, t in enumerate(texts)]
    return [*rows, (None, "null key", None, None, None, None, None), (5, texts[5], "en", "s1", 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low_words(text):
    return WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def test_token_counts_equal_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tracelake.llm.queries import WORD_BPE
    from tracelake.llm.tokens import PrefixCounter, ids, token_counts

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((-1 if r[0] is None else r[0], size(r[1])) for r in made())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in token_counts(docs, WORD_BPE).collect()) == want
    assert token_counts(empty, WORD_BPE).count() == 0
    counter, r = PrefixCounter(WORD_BPE), random.Random(3)
    alphabet = [*"abAB 'sStT.,!\n\x1cΣσİéß½あ", "<|endoftext|>", "'re", "́"]
    for _ in range(300):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert counter.count(text) == size(text)
        assert counter.prefix_counts(text) == [size(text[:i]) for i in range(len(text) + 1)]
        assert list(ids(WORD_BPE).of([text])[0]) == library.encode(text, add_special_tokens=False).ids
    assert size(counter.truncate("some words that are cut", 3)) <= 3
    for long in ("é" * 3000 + "ß'rEx" + "日本" * 500, "don't." * 800, "<" * 400 + "a|>" * 100):  # one chunk each
        counts = counter.prefix_counts(long)
        assert [counts[i] for i in range(0, len(long) + 1, 97)] == [size(long[:i]) for i in range(0, len(long) + 1, 97)]


def test_packing_is_gapless_and_bounded(docs, empty):
    from tracelake.llm.packing import evolve, pack
    from tracelake.llm.queries import WORD_BPE
    from tracelake.llm.tokens import ids

    found = pack(docs, WORD_BPE, capacity=256, shard_items=40).toPandas()
    for _, group in found.sort_values("offset").groupby("sequence_id"):
        assert (group["offset"] == group["length"].cumsum() - group["length"]).all() and group["length"].sum() <= 256
    whole = [np.append(ids(WORD_BPE).of([r[1] or ""])[0], np.uint32(1)).astype("<u4") for r in made()]
    want = sorted((p * 256, len(x[p * 256 :][:256]), zlib.crc32(x[p * 256 :][:256].tobytes())) for x in whole for p in range(-(-len(x) // 256)))
    assert sorted(zip(found["start"], found["length"], found["ids_crc32"], strict=True)) == want
    assert pack(empty, WORD_BPE).count() == 0
    again = pack(docs, WORD_BPE, capacity=256, shard_items=40).toPandas()
    key = ["start", "length", "ids_crc32", "offset"]
    assert sorted(map(tuple, again[key].to_numpy())) == sorted(map(tuple, found[key].to_numpy()))
    r = np.random.default_rng(0)
    sizes = np.concatenate([[a, b, 1000 - a - b] for a, b in zip(r.integers(380, 490, 60), r.integers(250, 255, 60), strict=True)]).astype("i4")
    people = evolve(sizes, [], 1000, random.Random(1), 8, 60)
    assert sorted(i for b in people[0] for i in b) == list(range(180)) and all(sizes[b].sum() <= 1000 for b in people[0])
    assert len(people[0]) <= len(evolve(sizes, [], 1000, random.Random(1), 1, 0)[0])


def test_every_shard_is_searched(spark):
    from tracelake.llm import packing as k

    r = np.random.default_rng(1)
    rows = [(int(i), int(x)) for i, x in enumerate(r.integers(200, 480, 360))]
    dealt = k.deal(spark.createDataFrame(rows, "id long, length long"), 90)
    plans = k.search(dealt, 1000, 3, 3, 3, 6)
    report = k.improvement(plans).first()
    assert report.shards == 4 and report.improved == 4  # best fit leaves bins that crossover fills better
    for plan in plans.collect():
        assert (plan.bins, plan.uneven) <= (plan.seed_bins, plan.seed_uneven)


@pytest.fixture(scope="module")
def classes(docs):
    from tracelake.llm.near_dup import jaccard_components

    return jaccard_components(docs).collect()


def test_jaccard_components_equal_brute_force(docs, empty, classes):
    from tracelake.llm.near_dup import jaccard_components

    sets = []
    for r in made():
        w = low_words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    names, parent = [r[0] for r in made()], list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if None not in (names[i], names[j]) and (names[i] == names[j] or (both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both))):
                parent[root(i)] = root(j)
    least = {}
    for i, name in enumerate(names):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    want = sorted((-1 if n is None else n, len(s), -1 if n is None else least[root(i)]) for i, (n, s) in enumerate(zip(names, sets, strict=True)))
    got = classes
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert jaccard_components(empty).count() == 0


def test_hot_classes_are_joined_apart(spark, monkeypatch, docs, classes):
    from tracelake.llm import components, near_dup

    want = sorted(map(str, classes))
    for module in (components, near_dup):
        monkeypatch.setattr(module, "hot_limit", lambda rows: 3)
    assert sorted(map(str, near_dup.jaccard_components(docs).collect())) == want
    left = spark.createDataFrame([(1, "a")] * 9 + [(2, "b"), (3, "c"), (None, "d")] + [(4, "e")] * 5, "k int, x string")
    right = spark.createDataFrame([(1, "r"), (2, "s")], "k int, y string")
    for how in ("inner", "left"):
        found = components.hot_join(left, right, ["k"], left.groupBy("k").count().where("count > 3"), how)
        assert sorted(map(str, found.select("k", "x", "y").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "x", "y").collect()))
    with pytest.raises(TypeError):
        near_dup.jaccard_components(left.select(F.col("x").alias("doc_id"), F.col("x").alias("text")))


def test_repeated_key_with_another_text_keeps_its_links(spark):
    from tracelake.llm.near_dup import jaccard_components

    r = random.Random(3)
    say = lambda: " ".join(str(r.randint(0, 10**6)) for _ in range(60))
    t, u = say(), say()
    rows = [(1, t), (5, t), (5, u), (9, u + " end"), (11, say())]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(1, 1), (5, 1), (5, 1), (9, 1), (11, 11)]


def test_signatures_meet_whenever_sets_are_similar():
    from tracelake.llm.near_dup import signatures

    r = np.random.default_rng(5)
    for size in (1, 2, 3, 4, 7, 20, 60, 200):
        for _ in range(20):
            a = r.integers(0, 2**63, size, dtype=np.uint64)
            b = np.concatenate([a[r.permutation(size)[: max(1, math.ceil(size * 6 / 7))]], r.integers(0, 2**63, size // 12, dtype=np.uint64)])
            both = len(set(a) & set(b))
            if 100 * both >= 75 * (len(set(a)) + len(set(b)) - both):
                values = np.concatenate([np.sort(a), np.sort(b)])
                for frequent in (None, values % np.uint64(3) == 0, np.ones(len(values), bool)):
                    sums, owner = signatures(values, np.array([0, len(a), len(values)]), 75, frequent)
                    assert set(sums[owner == 0]) & set(sums[owner == 1])


def test_sketches_bound_what_sets_share():
    from tracelake.llm.near_dup import may_link
    from tracelake.llm.shingles import folded, most_common, sketches

    r = np.random.default_rng(6)
    for size in (1, 5, 40, 70, 300, 5000, 700_000):
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(0.9 * len(a)))], r.integers(0, 2**63, size // 8, dtype=np.uint64)]))
        other = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        found = [np.frombuffer(sketches(x, np.array([0, len(x)]))[0], "u1")[None, :] for x in (a, b, other)]
        width = min(x.shape[1] for x in found)
        found = [folded(x, width) for x in found]
        assert most_common(found[0], found[1])[0] >= len(np.intersect1d(a, b))
        sizes = [np.array([len(x)]) for x in (a, b, other)]
        assert may_link(sizes[0], found[0], sizes[1], found[1], 75)[0]
        if size == 300:
            assert not may_link(sizes[0], found[0], sizes[2], found[2], 75)[0]


def test_repeats_are_removed_like_brute_force(docs, empty):
    from tracelake.llm.suffix_dedup import remove_repeats

    seen, want = collections.defaultdict(lambda: math.inf), []
    rows = made()
    for name, text, *_ in rows:
        b = (text or "").encode()
        if name is not None:
            for j in range(len(b) - 49):
                seen[b[j : j + 50]] = min(seen[b[j : j + 50]], name)
    for name, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49 if name is not None else 0):
            if seen[b[j : j + 50]] < name:
                gone[j : j + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        want.append((-1 if name is None else name, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    for args in ({}, {"segment_bits": (3, 48)}):  # the first attempt full of collisions
        got = remove_repeats(docs, **args).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    with pytest.raises(RuntimeError):
        remove_repeats(docs, segment_bits=(1,))
    assert remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, length=400)
    with pytest.raises(TypeError):
        remove_repeats(docs, key="key")


def test_language_model_counts_are_exact(docs, empty):
    from tracelake.llm.bloom_lm import score_texts

    held = lambda n: n is not None and zlib.crc32(str(n).encode()) % 5 == 1
    tokens = [(r[0], [*low_words(r[1]), None]) for r in made()]
    counts = collections.Counter(t for n, ts in tokens if not held(n) for t in ts)
    total, distinct = sum(counts.values()), len(counts)
    base = lambda ts: sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in ts)
    want = sorted((-1 if n is None else n, held(n), len(ts), sum(counts[t] > 0 for t in ts), round(base(ts), 6)) for n, ts in tokens)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    for args in ({}, {"slice_bytes": 2000, "head_words": 50}):
        got = score_texts(docs, rest, **args).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
        assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert score_texts(empty, rest).count() == 0


def thue_morse(n):
    """Two words of n letters, each the other one with a and b exchanged: prefix polynomials modulo 2**64 can't tell them apart."""
    return ["".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_different_words_are_different(spark, n):
    from tracelake.llm.bloom_lm import score_texts
    from tracelake.llm.near_dup import jaccard_components

    one, two = thue_morse(n)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(docs).collect()) == [(1, 1), (2, 2), (3, 1)]
    found = score_texts(docs, F.col("doc_id") == 2).collect()
    assert sorted((r.doc_id, r.n_known) for r in found) == [(1, 2), (2, 1), (3, 2)]


def test_words_by_their_bytes():
    from tracelake.llm.common import slice_hashes

    r = np.random.default_rng(0)
    data = r.integers(97, 99, 5000).astype(np.uint8)
    starts = r.integers(0, 4900, 4000)
    ends = starts + r.integers(0, 40, 4000)
    by_bytes = collections.defaultdict(set)
    for a, b, h in zip(starts.tolist(), ends.tolist(), slice_hashes(data, starts, ends).tolist(), strict=True):
        by_bytes[data[a:b].tobytes()].add(h)
    assert all(len(h) == 1 for h in by_bytes.values()) and len(set().union(*by_bytes.values())) == len(by_bytes)


def test_false_hits_of_the_filter_are_rare():
    from tracelake.llm.bloom_lm import Filter

    r = np.random.default_rng(0)
    keys = r.integers(0, 2**48, 400_000).astype(np.uint64)
    count = np.where(r.random(200_000) < 0.8, 1, r.integers(2, 40, 200_000))
    there, other = keys[:200_000], keys[200_000:]
    filter_, where = Filter([Filter.build(there, count)]), np.zeros(200_000, np.int64)
    assert (filter_.level(other, where) > 0).mean() < 1e-3
    found = filter_.level(there, where)
    assert (found >= Filter.levels(count)).all() and (found > Filter.levels(count)).mean() < 1e-3


def test_language_model_as_registered(docs, spark):
    """The default filter against exact counts: nearly all texts have the very score, and no session setting changes one."""
    from tracelake.llm.bloom_lm import score_texts

    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    score = lambda **a: sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in score_texts(docs, rest, **a).collect())
    exact, found = score(bits=200), score()
    assert sum(abs(a[2] - b[2]) > 1e-6 * a[1] for a, b in zip(exact, found, strict=True)) <= 0.1 * len(found)
    assert all(abs(a[2] - b[2]) <= 0.02 * a[1] + 2.5 for a, b in zip(exact, found, strict=True))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert score() == found
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_language_model_equals_brute_force_however_it_is_spread(docs, monkeypatch):
    from tracelake.llm import bloom_lm
    from tracelake.llm.bloom_lm import BETA, score_texts

    held = lambda n: n is not None and zlib.crc32(str(n).encode()) % 5 == 1
    texts = [(r[0], [*low_words(r[1]), None]) for r in made()]
    pairs = lambda ts: list(zip(["begin", *ts[:-1]], ts, strict=True))
    one, two = collections.Counter(), collections.Counter()
    for n, ts in texts:
        if not held(n):
            one.update(ts)
            two.update(pairs(ts))
    total, docs_ = sum(one.values()), sum(not held(n) for n, _ in texts)
    level = collections.defaultdict(list)
    for c in two.values():
        level[c.bit_length()].append(c)

    def p(h, w):
        prior, of = (one[w] + 0.5) / (total + 0.5 * (len(one) + 1)), docs_ if h == "begin" else one[h]
        c = two[h, w]
        quantised = sum(level[c.bit_length()]) / len(level[c.bit_length()]) if c else 0
        return (1 - BETA) * min(1, quantised / of) + BETA * prior if of else prior

    want = sorted((-1 if n is None else n, len(ts), sum(math.log10(p(*x)) for x in pairs(ts))) for n, ts in texts)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = []
    for hot, args in ((bloom_lm.HOT, {}), (8, {"slice_bytes": 0}), (1, {"head_words": 0, "slice_bytes": 0}), (8, {"head_words": 50, "slice_bytes": 20_000})):
        monkeypatch.setattr(bloom_lm, "HOT", hot)
        found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in score_texts(docs, rest, bits=200, **args).collect()))
        for a, b in zip(found[-1], want, strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) <= 1e-6 * b[1]
    assert all(f == found[0] for f in found)
    # Weighed by their counts, the probabilities of what may follow a context sum to 1 but for what min cuts off.
    mass = sum((docs_ if h == "begin" else one[h]) * p(h, w) for h in ["begin", *(w for w in one if w is not None)] for w in one)
    assert 0.9 < mass / (docs_ + sum(c for w, c in one.items() if w is not None)) <= 1 + 1e-9


def test_quality_keeps_labels_out_of_held_out_rows(spark, docs, empty):
    from tracelake.llm.quality import score_quality

    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["plain", "words", "of", "some", "text", "here"]) + str(r.randint(0, 99)) for _ in range(60)) if i % 4 else "JUNK!! " * 40) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = score_quality(texts, labels).toPandas()
    held = got[got["held_out"]]
    assert set(held["doc_id"]) == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held["predicted"] == (held["doc_id"] % 4 > 0)).all()
    flipped = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    again = score_quality(texts, flipped).toPandas()
    assert np.allclose(got.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])
    odd = score_quality(docs, labels.limit(0)).toPandas()
    assert len(odd) == docs.count() and odd["score"].between(0, 1).all()
    assert score_quality(empty, labels).count() == 0


def test_quality_fit_equals_brute_force(spark):
    """The fit and the prior on a small table against plain gradient descent, and the non-negative rule."""
    from tracelake.llm import quality as q

    r = np.random.default_rng(8)
    good, bad = r.normal(0, 1, (400, q.BASIC)), r.normal(1.5, 1, (400, q.BASIC))
    u, p = np.vstack([good[:200], bad[:300]]).astype("<f4"), good[200:].astype("<f4")
    frame = lambda x: spark.createDataFrame([(row.tobytes(),) for row in x], "x binary").repartition(3)
    usual = np.full(q.BASIC, -2.0), np.full(q.BASIC, 2.0), np.full(q.BASIC, 4.0)
    eu, ep, prior = q.expand(u, *usual), q.expand(p, *usual), 0.4
    risk = lambda w: -prior * ep.mean(0) @ w + np.logaddexp(0, eu @ w).mean() + 0.05 / 2 * w @ w
    slope = lambda w: -prior * ep.mean(0) + (1 / (1 + np.exp(-eu @ w))) @ eu / len(eu) + 0.05 * w
    negative = lambda w, prior: np.logaddexp(0, eu @ w).mean() - prior * np.logaddexp(0, ep @ w).mean()
    best = np.zeros(eu.shape[1])
    for _ in range(4000):
        best -= 0.2 * slope(best)
    w = q.fit(frame(u), frame(p), prior, usual, ridge=0.05)
    assert negative(best, prior) > 0 and abs(risk(w) - risk(best)) < 1e-5 and np.abs(w - best).max() < 0.01
    for wrong in (0.7, 0.95):  # where the unbound fit would make the negatives' part negative
        assert negative(q.fit(frame(u), frame(p), wrong, usual), wrong) >= 0
    found = q.class_prior(frame(u), frame(p), w, usual)
    assert 0.35 < found < 0.5


def test_top_k_equals_brute_force(spark):
    from tracelake.llm.top_k import top_k

    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=16)]) for i in range(150)] + [(150, None), (151, [float("nan")] * 16), (None, [1.0] * 16), (7, [0.5] * 16), (200, [0.25] * 16), (201, [0.25] * 16)]
    found = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0)
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and not any(map(math.isnan, v))]
    want = []
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_is_exact_for_large_components(spark, monkeypatch):
    from tracelake.llm import top_k as module
    from tracelake.llm.top_k import top_k

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6) * 10.0 ** r.integers(0, 9, 6)]) for i in range(120)]
    rows += [(200, [1e30, 1.0] + [0.0] * 4), (201, [-1e30, 3.0] + [0.0] * 4), (202, [1e30, 2.0] + [0.0] * 4), (203, [1e308] * 6), (250, [1e7, -1e7, 1e7]), (251, []), (300, [0.0] * 6)]
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v] + [0] * (6 - len(v))) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:5]
            want += [(i, n + 1, j, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, j) in enumerate(best)]
    df = spark.createDataFrame([(*row, "x", "y") for row in rows], "vec_id long, embedding array<double>, lane string, score string")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)
    monkeypatch.setattr(module, "SHARD", 7)  # many shards and lanes
    monkeypatch.setattr(module, "QUERIES", 2)
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 50 == 0).collect())) == sorted(want)


def test_contaminated_finds_passages_and_rewordings(spark, empty, monkeypatch):
    from tracelake.llm import decontaminate
    from tracelake.llm.decontaminate import common, contaminated

    rows = made(7)
    r = random.Random(4)
    items = [(i, " ".join(r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 400)) for _ in range(30))) for i in range(6)] + [(90, None), (91, "")]
    reworded = items[1][1].split()
    reworded[3] = reworded[17] = "other"
    rows += [(500, rows[2][1] + " " + items[0][1] + " " + rows[4][1], "en", "s", 1, None, None), (501, " ".join(reworded), "en", "s", 1, None, None)]
    found = contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id) for x in found) == [(500, 0), (501, 1)]
    assert contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    monkeypatch.setattr(decontaminate, "ITEMS", 2)  # the same in blocks
    blocks = contaminated(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, found))
    assert common([1, 2, 3, 4], [2, 9, 4]) == 2
    named = spark.createDataFrame([(f"d{x[0]}", x[1], 1, "a") for x in rows[-2:]] + [("long", "word " * 200_000 + items[2][1], 1, "a")], "name string, body string, item_id int, coverage string")
    texts = spark.createDataFrame([(f"i{i}", t, 5) for i, t in items], "item string, said string, doc_id int")
    found = contaminated(named, texts, key="name", text="body", item_key="item", item_text="said").collect()
    assert sorted((x.doc_id, x.item_id) for x in found) == [("d500", "i0"), ("d501", "i1"), ("long", "i2")]
    assert contaminated(named, texts.limit(0), key="name", text="body", item_key="item", item_text="said").count() == 0


def test_contaminated_equals_brute_force(spark):
    from tracelake.llm.decontaminate import contaminated, leaked

    r = random.Random(11)
    rows, items = [(x[0], x[1]) for x in made(7)], []
    common, rare = "".join(x[1] + " " for x in made(7)[:20]).split(), lambda: "".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(4))
    for i in range(24):
        items.append((i, " ".join(rare() if r.random() < 0.4 else r.choice(common) for _ in range((1, 3, 9, 15, 20, 58)[i % 6]))))
        said = items[-1][1].split()
        for share in (0, 0.2, 0.4, 0.45, 0.5):
            body = [w if r.random() >= share else rare() for w in said]
            if share == 0.45:
                body[-3:] = said[-3:]
            rows.append((1000 * i + int(100 * share) + 100, " ".join([r.choice(common) for _ in range(r.randint(0, 300))] + body + [r.choice(common) for _ in range(r.randint(0, 300))])))
    want = set()
    for item, text in items:
        mine = low_words(text)
        for doc, other in rows:
            w = low_words(other)
            if any(leaked(mine, w[a : a + len(mine) + len(mine) // 4]) for a in range(len(w))):
                want.add((doc, item))
    found = contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want


def test_line_dedup_and_preference_pairs(spark, monkeypatch):
    from tracelake.llm import line_dedup
    from tracelake.llm.line_dedup import drop_boilerplate
    from tracelake.llm.preference import preference_pairs

    rows = [(i, "h", f"menu\nown line {i}\n") for i in range(5)] + [(9, "h", "menu\nown line 0\n")] * 4 + [(6, None, None), (7, "", ""), (8, "k", "menu\nown")]
    got = drop_boilerplate(spark.createDataFrame(rows, "id int, host string, text string"), F.col("host"), F.col("text")).collect()
    assert sorted((r.id, r._text or "", r.n_lines, r.n_dropped) for r in got)[:2] == [(0, "own line 0\n", 3, 1), (1, "own line 1\n", 3, 1)]
    assert {(r.id, r._text) for r in got if r.id in (6, 7, 8)} == {(6, None), (7, ""), (8, "menu\nown")}
    names = "id int, host string, text string, _drop int, _host string, _text int, _kept int, bad int, row int, n_lines string, deal int"
    odd = drop_boilerplate(spark.createDataFrame([(*row, 1, "mine", 2, 3, 4, 5, "six", 7) for row in rows], names), F.col("host"), F.col("text"))
    assert odd.columns == ["id", "host", "text", "_drop", "_host_input", "_text_input", "_kept", "bad", "row", "n_lines_input", "deal", "_host", "_text", "n_lines", "n_dropped"]
    plain = sorted((r.id, r._text or "", r.n_lines, r.n_dropped) for r in got)
    assert sorted((r.id, r._text or "", r.n_lines, r.n_dropped) for r in odd.collect()) == plain and odd.first()["_host_input"] == "mine"
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert sorted((r.id, r._text or "", r.n_lines, r.n_dropped) for r in drop_boilerplate(spark.createDataFrame(rows, "id int, host string, text string"), F.col("host"), F.col("text")).collect()) == plain
    assert drop_boilerplate(spark.createDataFrame([], "id int, host string, text string"), F.col("host"), F.col("text")).count() == 0
    long = drop_boilerplate(spark.createDataFrame([(1, "h", "x\n" * 200_000)], "id int, host string, text string"), F.col("host"), F.col("text")).first()
    assert (long.n_lines, long.n_dropped) == (200_001, 0)
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "user", "more"), (2, 0, None, "alone"), (4, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {r.pair_id: r for r in preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(found) == {0, 1, 2}
    assert (found[0].prompt_turns, found[0].prompt) == (1, "<|user|>\nq<|end|>\n")
    span = found[0].chosen_spans[0]
    assert found[0].chosen[span.start : span.end] == "good<|end|>\n" and len(found[0].rejected_spans) == 1
    assert (found[1].prompt_turns, found[1].rejected) == (0, "") and (found[2].prompt_turns, found[2].chosen) == (1, "")


def test_preference_pairs_of_odd_tables(spark):
    from tracelake.llm.preference import preference_pairs

    names = "conv_id long, turn long, role string, text string, pair_id string, _chosen int, c string, n int, p int"
    pairs = lambda rows: {r.pair_id: r for r in preference_pairs(spark.createDataFrame([(*row, "x", 1, "y", 2, 3) for row in rows], names), F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert pairs([]) == {}
    long = "very long " * 300_000
    found = pairs([(0, 0, "user", long), (1, 0, "user", long), (0, 1, "assistant", long), (2, 0, "user", "q"), (2, 0, "user", "q"), (3, 0, "user", "q"), (4, None, None, None)])
    assert found[0].prompt_turns == 1 and len(found[0].prompt) == len(long) + len("<|user|>\n<|end|>\n") and found[0].rejected == ""
    assert (found[1].prompt_turns, found[1].chosen, found[1].rejected) == (1, "<|user|>\nq<|end|>\n", "")
    assert (found[2].prompt_turns, found[2].chosen) == (0, "<||>\n<|end|>\n")


def test_components(spark):
    from tracelake.llm.components import components

    pairs = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_keep_their_contract(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_sums_of_runs_and_covers_of_repeated_words(monkeypatch):
    """Runs of any length are summed a row of each at once; windows that can't hold an item are told by counts that no repeated word raises."""
    from tracelake.llm import decontaminate as d

    r = np.random.default_rng(5)
    rows = r.integers(0, 50, 3000)
    for first in (np.arange(0, 3000, 16), np.array([0, 1, 2000, 2003]), np.array([0]), np.unique(np.r_[0, r.integers(0, 3000, 400)])):
        table = r.integers(-9, 9, (50, 3)).astype(np.float32)
        assert (d.summed(table, rows, first) == np.add.reduceat(table[rows], first, axis=0)).all()
    assert d.summed(table, rows[:0], rows[:0]).shape == (0, 3)

    for n in range(600):
        item = r.integers(0, r.choice([2, 5, 30]), r.choice([1, 2, 3, 8, 20])).tolist()
        text = r.integers(0, r.choice([3, 9, 60]), r.choice([0, 2, 15, 60])).tolist()
        if n % 2:
            text[5:5] = [x for x in item if r.random() < 0.7]
        m, windows = len(item), [text[a : a + len(item) + len(item) // 4] for a in range(len(text)) if text[a] in item]
        assert d.cover(item, np.array(text, np.uint64)) == max([d.common(item, w) for w in windows if d.leaked(item, w)], default=0) / m

    runs = []
    longest = d.longest
    monkeypatch.setattr(d, "longest", lambda *args: runs.append(1) or longest(*args))
    item = list(range(10, 20))
    assert d.cover(item, np.array([10, 11] * 300, np.uint64)) == 0 and not runs
    # Half of it without the answer isn't looked at either; with the answer it is found.
    assert d.cover(item, np.array([10, 11, 12, 13, 14] * 50, np.uint64)) == 0 and not runs
    assert d.cover(item, np.array([10, 11, 1, 17, 18, 19], np.uint64)) == 0.5 and runs
