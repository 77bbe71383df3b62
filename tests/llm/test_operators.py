"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats, empty tables and
clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionloom.llm import adsampling, impacts, langid, licenses, mixing, packing, pii, ppm, queries, scale, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    """Odd documents: null and empty texts, a null id, repeats, ties, a long text, license lines and personal data."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "ümlaut", "naïve", "Omega", "zeta9"]
    plain = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 3, 40, 41, 400)]
    texts = [None, "", " \t\n", *plain, plain[3], plain[3] + " extra", "Released under the MIT License. mit license", "under the GNU General Public License v3", "mail joe@x.example.org or +1 (310) 555-4510, 10.0.0.1, 4111 1111 1111 1111", "漢字 😀 text", "x" * 5000, " ".join(rng.choices(words, k=20000))]
    rows = [(i, t, ["en", "fr", None][i % 3], ["src0", "src0", "src1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[3], (None, "alpha beta gamma", "en", "src0", 16)]
    return spark.createDataFrame(rows, DOCS).withColumn("fingerprint", F.lit("clash")).withColumn("score", F.lit(-1)).withColumn("position", F.lit(0)).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def all_rows(df):
    return sorted(map(str, df.collect()))


PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    out = [(i, label) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(out)


def test_licenses(spark, docs, none):
    got = licenses.licenses(docs)
    assert got.count() == docs.count() and licenses.licenses(none).count() == 0
    texts = dict(docs.select("doc_id", "text").collect())
    for r in got.collect():
        n, places = base_places(texts[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    changed = notice.replace("free of charge", "free of any charge")
    spans = licenses.license_spans(spark.createDataFrame([(1, "one two " + changed)], "doc_id long, text string")).collect()
    assert [(s.label, s.start) for s in spans] == [("mit-grant", 2)] and spans[0].coverage > 0.8
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxicity_held_out(spark):
    docs, labels = scale.table(spark, "/root/testdata/sf0.1", "documents"), scale.table(spark, "/root/testdata/sf0.1", "labels")
    test = scale.remainder(F.col("doc_id"), 5) == 1
    model = toxicity.train(docs.where(~test), labels.where(~test))
    got = toxicity.score(docs.where(test), model).join(labels, "doc_id").toPandas()
    true, said = got.toxic == 1, got.is_toxic
    assert (true & said).sum() / max(1, said.sum()) > 0.9 and (true & said).sum() / true.sum() > 0.75
    rank = got.toxicity.rank()
    auc = (rank[true].sum() - true.sum() * (true.sum() + 1) / 2) / (true.sum() * (~true).sum())
    assert auc > 0.95


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(12)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())
    assert toxicity.toxicity(none, labels).count() == 0
    assert all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert toxicity.remove_toxic(docs, labels.limit(0)).count() == docs.count()


def test_nnpu_corrects_the_risk():
    rng = np.random.default_rng(0)
    toxic, clean = [1, 2], [3, 4]
    row = lambda own: (np.array([rng.choice(own), 5], np.int32), np.ones(2, np.float32))
    p = toxicity.Rows(*zip(*[row(toxic) for _ in range(200)], strict=True))
    u = toxicity.Rows(*zip(*[row(toxic if rng.random() < 0.3 else clean) for _ in range(2000)], strict=True))
    w, b = toxicity.fit_nnpu(p, u, 0.3)
    assert min(w[1], w[2]) + w[5] + b > 0 > max(w[3], w[4]) + w[5] + b


def test_nnpu_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(1)
    loss = lambda z: np.array([math.log1p(math.exp(x)) for x in z])
    seen = set()
    for prior in (0.1, 0.5, 0.9):
        for shift in (-3.0, 0.0, 3.0):
            zp, zu = rng.normal(-shift, 1, 7), rng.normal(shift, 1, 11)

            def risks(zp, zu, prior=prior):
                return prior * loss(-zp).mean(), loss(zu).mean() - prior * loss(zp).mean()

            above, below = risks(zp, zu)
            seen.add(below >= 0)
            lowered = (lambda zp, zu: sum(risks(zp, zu))) if below >= 0 else (lambda zp, zu: -risks(zp, zu)[1])
            gp, gu = toxicity.slopes(zp, zu, prior)
            for own, z, put in ((gp, zp, lambda z: (z, zu)), (gu, zu, lambda z: (zp, z))):
                for i in range(len(z)):
                    step = np.zeros(len(z))
                    step[i] = 1e-5
                    assert own[i] == pytest.approx((lowered(*put(z + step)) - lowered(*put(z - step))) / 2e-5, abs=1e-6)
    assert seen == {True, False}


def test_samples_are_bounded(spark, monkeypatch):
    """Null and repeated ids and equal rows neither fill nor exceed the samples; a very long text is read whole."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(9)
    rows = [(None, "same words in every row", "en")] * 3_000 + [(None, " ".join(rng.choices(words, k=8)), "en") for _ in range(7_000)] + [(k, "awful words " + rng.choice(words), "fr") for k in range(300)] + [(5, f"awful words {k}", "fr") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    labels = spark.createDataFrame([(k, 1 if k < 200 else 0) for k in range(300)], "doc_id long, toxic int")
    for name, n in (("MAX_POSITIVE", 50), ("MAX_UNLABELLED", 100), ("MAX_CALIBRATION", 40)):
        monkeypatch.setattr(toxicity, name, n)
    seen = []
    monkeypatch.setattr(toxicity, "written", lambda df: seen.append(scale.written(df)) or seen[-1])
    assert toxicity.train(docs, labels) is not None
    kinds = {r.kind: r["count"] for r in seen[0].groupBy("kind").count().collect()}
    assert kinds[3] < 2 * 100 and seen[0].where("kind = 3").select("lot").distinct().count() == kinds[3]
    monkeypatch.setattr(langid, "MAX_DOCS", 100)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 1)
    assert langid.train(docs).languages == ["en"]
    long = spark.createDataFrame([(1, "word " * 300_000 + "awful", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    model = toxicity.train(docs, labels)
    assert toxicity.score(long, model).count() == 2 and langid.language_id(long).count() == 2
    got = {r.doc_id: r for r in ppm.language_model(long).collect()}
    assert got[1].n_tokens == 300_002 and got[2].n_tokens == 1
    assert len(by_id(simhash.near_duplicates(long))) == 2 and by_id(licenses.licenses(long))[1].n_words == 300_001 and packing.pack(long, TOKENIZER).count() > 250


def test_batches_are_bounded_in_bytes(spark):
    scale.text_batches(spark)
    df = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 64 and max(r.n for r in sizes) <= 10


def ppm_brute(train, text):
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    codes = lambda t: [0] * ppm.ORDER + [b + 1 for b in (t or "").encode()] + [ppm.END]
    for t in train:
        s = codes(t)
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[k][tuple(s[i - k : i])][s[i]] += 1
    s, total = codes(text), 0.0
    for i in range(ppm.ORDER, len(s)):
        out = set()
        for k in range(ppm.ORDER, -1, -1):
            c = counts[k].get(tuple(s[i - k : i]))
            if not c:
                continue
            live = {x: n for x, n in c.items() if x not in out}
            whole = sum(live.values()) + len(live)
            if s[i] in live:
                total += math.log10(live[s[i]] / whole)
                break
            total += math.log10(len(live) / whole) if whole else 0
            out |= set(c)
        else:
            total -= math.log10(ppm.SYMBOLS - len(counts[0][()]))
    return total


@pytest.mark.parametrize("nodes", [1 << 21, 64])
def test_ppm(spark, docs, none, nodes, monkeypatch):
    monkeypatch.setattr(ppm, "NODES", nodes)  # with few, nearly all n-grams and words are joined
    small = docs.where("length(coalesce(text, '')) < 3000")
    got = ppm.language_model(small).collect()
    rows = small.select("doc_id", "text").collect()
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 != 2]
    split = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [None]
    counts = collections.Counter(w for t in train for w in split(t))
    n, v = sum(counts.values()), len(counts)
    texts = {r.doc_id: r.text for r in rows}
    assert len(got) == len(rows)
    for r in got:
        w = split(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(ppm_brute(train, texts[r.doc_id]))
    assert ppm.language_model(none).count() == 0
    assert ppm.language_model(docs).count() == docs.count()


def test_ppm_chances_sum_to_one():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 103, 3000).astype(np.uint8)
    keys = np.concatenate([k for _, k in ppm.symbol_keys(text, np.array([0, 1000, 1000, 3000]))])
    trie = ppm.build([ppm.summed(ppm.low(keys, k), np.ones(len(keys))) for k in range(ppm.ORDER + 1)])
    for context in (0, 98 | 99 << 9, 98 | 99 << 9 | 100 << 18 | 101 << 27, 200 | 98 << 9 | 1 << 18):
        keys = (np.uint64(context) << np.uint64(9)) | np.arange(1, ppm.SYMBOLS + 1, dtype=np.uint64)
        assert np.exp(trie.log_chance(keys)).sum() == pytest.approx(1)


def test_symbol_keys_in_slices(monkeypatch):
    text, offsets = np.frombuffer(b"abcdefgh\x00\xffzz", np.uint8), np.array([0, 0, 5, 5, 12])
    whole = [np.concatenate(x) for x in zip(*ppm.symbol_keys(text, offsets))]
    monkeypatch.setattr(ppm, "SLICE", 3)
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*ppm.symbol_keys(text, offsets))))
    assert list(whole[0]) == [0, *[1] * 6, 2, *[3] * 8]
    assert int(whole[1][0]) == ppm.END and int(whole[1][2]) == 99 | 98 << 9


def test_nearest_vectors(spark):
    got = queries.op4_nearest_vectors(spark, SF).toPandas()
    rows = scale.table(spark, SF, "embeddings").toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))][:20]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [s[ids == v][0] for v in own.vec_id]) and (np.diff(own.score) <= 0).all()
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 20
    assert hit / total >= 0.9


def one_list(x, k):
    """An index of one list over unit vectors, and its k nearest of each of the first 50 by brute force."""
    d = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(1).normal(size=(d + 1, d + 1)))[0]
    score = x[:50] @ x.T
    score[np.arange(50), np.arange(50)] = -np.inf
    return adsampling.Index(d, 1.0, rotation, np.zeros((1, d + 1)), 1), np.argsort(-score, axis=1, kind="stable")[:, :k], score


def test_tests_abandon_candidates_early():
    x = np.random.default_rng(0).normal(size=(6_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, want, score = one_list(x, 20)
    kth = np.sort(score[:, :1_500], axis=1)[:, -20]  # what a scan of the first 1,500 finds
    left = pa.table({"row_no": np.arange(6_000), "v": list(x), "list": np.zeros(6_000, np.int32)})
    right = lambda kth: pa.table({"row_no": np.arange(50), "v": list(x[:50]), "kth": kth, "lists": [[0]] * 50})
    for carried, least in ((kth, 0.4), (np.full(50, np.nan), 0.3)):
        best, _, _ = adsampling.search_cell(index, left, right(carried), 20)
        assert best.met == 50 * 5_999 and best.abandoned > least * best.met
        assert np.mean([len(set(a) & set(b)) for a, b in zip(best.place, want)]) >= 0.9 * 20


def test_abandoned_pairs_are_not_computed():
    """Multiply-adds beside those of all pairs, with the bound that a query brings from its nearest lists."""
    x = np.random.default_rng(2).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, want, score = one_list(x, 20)
    kth = np.sort(score[:, :6_000], axis=1)[:, -20]
    left = pa.table({"row_no": np.arange(20_000), "v": list(x), "list": np.zeros(20_000, np.int32)})
    best, _, _ = adsampling.search_cell(index, left, pa.table({"row_no": np.arange(50), "v": list(x[:50]), "kth": kth, "lists": [[0]] * 50}), 20)
    assert best.full == 50 * 20_000 * 65 and best.work < 0.75 * best.full
    assert np.mean([len(set(a) & set(b)) for a, b in zip(best.place, want)]) >= 0.95 * 20


def test_no_early_leave_without_tests(monkeypatch):
    monkeypatch.setattr(adsampling, "EPSILON", 1e9)
    x = np.random.default_rng(0).normal(size=(700, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index, want, _ = one_list(x, 5)
    left = pa.table({"row_no": np.arange(700), "v": list(x), "list": np.zeros(700, np.int32)})
    best, _, _ = adsampling.search_cell(index, left, pa.table({"row_no": np.arange(50), "v": list(x[:50]), "kth": np.full(50, np.nan), "lists": [[0]] * 50}), 5)
    assert best.abandoned == 0 and (best.place == want).all()


def test_cells_take_small_lists_together_and_cut_large_ones():
    index = adsampling.Index(1, 1.0, np.eye(2), np.zeros((5, 2)), 1)
    assert index.lay(np.array([3, 4, 25, 5, 6]), 10) == 6
    assert list(index.cell) == [0, 0, 1, 4, 5] and list(index.cells) == [1, 1, 3, 1, 1]


VECTORS = [(0, [1.0, 2.0, 3.0]), (20, [0.5, 0.25, 0.0]), (1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [1.0]), (1, [1.0, 2.0, 3.0]), (50, [-1.0, 2.0, 0.1]), (100, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]


def test_vector_edges(spark):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in VECTORS], "vec_id long, embedding array<double>, label int, rank int")
    near = adsampling.nearest(df, lambda c: c % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in near if r.query_id == 0] == [1, 1, 50, 8, 20] and {r.query_id for r in near} == {0, 20}
    top = impacts.top_products(df, lambda c: c % 50 == 0, 5).orderBy("query_id", "rank").collect()
    want = {}
    kept = [(i, [math.floor(256 * x) for x in v] + [0] * (3 - len(v))) for i, v in VECTORS if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q in (0, 50, 100):
        s = sorted((-sum(a * b for a, b in zip(dict(kept)[q], v)), i) for i, v in kept if i != q)[:5]
        want[q] = [(i, -n) for n, i in s]
    assert {q: [(r.vec_id, r.score) for r in top if r.query_id == q] for q in (0, 50, 100)} == want
    assert adsampling.nearest(df.limit(0), lambda c: c % 20 == 0).count() == impacts.top_products(df.limit(0), lambda c: c % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [150, 3_000_000_000])
@pytest.mark.parametrize("carried", [False, True])
def test_impact_blocks_are_exact(size, carried):
    rng = np.random.default_rng(1)
    for n, d in ((1, 2), (5, 3), (200, 8), (3000, 16)):
        x = rng.integers(-size, size, (n, d)).astype(float) // 4
        q = x[rng.integers(0, n, 20)] * rng.choice([1, -1], (20, 1))
        q[0] = 0
        scores = [np.delete(impacts.products(x, q[i]), i % n) for i in range(20)]
        bound = np.array([np.sort(s)[::-1][2] if carried and len(s) > 2 else -np.inf for s in scores], float)
        if size > 1e6:
            bound -= np.abs(bound) * 2.0**-52
        for i, rows in enumerate(impacts.Block(x).search(q, [np.array([i % n]) for i in range(20)], 5, bound)):
            many = 3 if carried else 5  # with a bound, at least the scores that reach it
            assert (np.sort(impacts.products(x[rows], q[i]))[::-1][:many] == np.sort(scores[i])[::-1][:many]).all()


@pytest.mark.parametrize(("n", "most"), [(2_000, 0.9), (8_192, 0.75)])
def test_impact_order_spares_work(n, most):
    """Multiply-adds beside all products', with the bound of another block and without one."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2 * n, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    q, own = x[:100], [np.array([i]) for i in range(100)]
    first = impacts.Block(x[:n])
    near = first.search(q, own, 5, np.full(100, -np.inf))
    bound = np.array([np.sort(first.scores(rows, v))[-5] for rows, v in zip(near, q, strict=True)], float)
    assert first.work < most * 100 * n * 64
    other = impacts.Block(x[n:])
    for rows, v in zip(other.search(q, [np.empty(0, int)] * 100, 5, bound), q, strict=True):
        other.scores(rows, v)
    assert other.work < 0.75 * 100 * n * 64


@pytest.mark.parametrize("x", [[[0.0, 0.0]] * 7, [[5.0], [5.0], [5.0], [-2.0]], [[2.0**27, 1.0], [2.0**27, 2.0], [-1.0, 3.0]] * 4])
@pytest.mark.parametrize("k", [1, 2, 20])
def test_impact_blocks_keep_what_no_proof_excludes(x, k):
    x = np.array(x)
    for i, rows in enumerate(impacts.Block(x).search(x[:3], [np.array([i]) for i in range(3)], k, np.full(3, -np.inf))):
        best = sorted((sum(int(a) * int(b) for a, b in zip(x[i], v, strict=True)) for j, v in enumerate(x) if j != i), reverse=True)[:k]
        assert i not in rows and sorted(impacts.products(x[rows], x[i]), reverse=True)[:k] == best


def test_impact_blocks_of_endless_products():
    x = np.array([[1e300, -1e300], [3.0, 1e300], [0.0, 1.0]] * 3)
    with pytest.raises(OverflowError):
        impacts.Block(x).search(x[:3], [np.array([i]) for i in range(3)], 2, np.full(3, -np.inf))


def test_repeated_ids_and_large_components(spark):
    rows = [(1, [0.5, 0.5]), (1, [5.0, 5.0]), (20, [1.0, 1.0]), (50, [70000.0, 1.0]), (7, [100000.0, 1.0]), (100, [-1e-9, 3e9]), (9, [2.0, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = adsampling.nearest(df.where("vec_id in (1, 20)"), lambda c: c == 20, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in near] == [(1, 10.0), (1, 1.0)]
    top = impacts.top_products(df, lambda c: c == 50, 5).orderBy("rank").collect()
    assert (top[0].vec_id, top[0].score) == (7, 458752000065536)
    exact = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    assert sorted((-r.score, r.vec_id) for r in top) == sorted((-exact(rows[3][1], v), i) for i, v in rows if i != 50)[:5]
    with pytest.raises(Exception, match="exceeds a long"):
        impacts.top_products(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)), lambda c: c == 50, 5).collect()


def test_bounds_carry_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(impacts, "BLOCK", 64)
    monkeypatch.setattr(adsampling, "BLOCK", 64)
    e = scale.table(spark, SF, "embeddings")
    rows = e.toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = impacts.top_products(e, lambda c: c % 50 == 0, 5).toPandas()
    whole = np.floor(256 * x).astype(int)
    for q in ids[ids % 50 == 0]:
        s = whole @ whole[ids == q][0]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own.vec_id) == list(ids[best]) and list(own.score) == list(s[best])
    near = adsampling.nearest(e, lambda c: c % 20 == 0, 20).toPandas()
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hit += len(set(best) & set(near[near.query_id == q].vec_id))
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


def fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and simhash.near_duplicates(none).count() == 0
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    group = {f: {f} for _, f in rows}
    for a in group:
        for b in list(group):
            if bin(a ^ b).count("1") <= 2 and group[a] is not group[b]:
                joined = group[a] | group[b]
                for f in joined:
                    group[f] = joined
    least = lambda f: min((i for i, g in rows if g in group[f] and i is not None), default=None)
    want = sorted(str((i, f, least(f))) for i, f in rows)
    assert sorted(str((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id)) for r in got) == want


@pytest.mark.parametrize("bits", [2, 3, 8])
def test_gray_tree_finds_all_links(bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64) * np.uint64(2)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(30)]]))
    tables = len(simhash.block_bounds(bits)) * (len(simhash.block_bounds(bits)) - 1) // 2 - len(simhash.block_bounds(bits)) + 1
    table = np.repeat(np.arange(tables), len(fp))
    a, b = simhash.local_forest(table, np.tile(fp, tables), bits)
    place = {int(f): i for i, f in enumerate(fp)}
    parent = list(range(len(fp)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a, b):
        parent[root(place[int(x)])] = root(place[int(y)])
    close = np.bitwise_count(fp[:, None] ^ fp[None]) <= bits
    label = np.arange(len(fp))
    for _ in range(len(fp)):
        label = np.where(close, label[None], len(fp)).min(1)
    same = np.array([root(i) for i in range(len(fp))])
    assert ((label[:, None] == label[None]) == (same[:, None] == same[None])).all()


def test_keep_representatives(spark, docs, none):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and simhash.keep_representatives(none).count() == 0
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 7, 8, 11, 12, 13, 14, 15, 16] and ids.count(None) == 1


def brute_groups(rows):
    """One row (id, text) of each group of near duplicates, by all pairs: the smallest id, nulls last."""
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5)) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (t := len(sets[a] | sets[b])) == 0 or len(sets[a] & sets[b]) >= 0.8 * t:
                label = [label[b] if x == label[a] else x for x in label]
    return sorted(min(((i is None, i) for (i, _), x in zip(rows, label) if x == y), key=str) for y in set(label))


def near_rows():
    """Rows of shared and null ids, equal rows, a chain, a cluster around no centre and unlike texts in one bucket."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = [(1, "one text"), (2, "same id, first text"), (2, "same id, other text entirely"), (2, "same id, first text"), (None, "one text"), (None, "no id at all here"), (None, "no id at all here"), (3, None), (4, " "), (4, "")]
    for k in range(70):
        t = list(base)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            t[at] = f"x{k}y{at}"
        rows.append((100 + k, " ".join(t)))
    return rows


def test_near_dedup_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 8)
    monkeypatch.setattr(simhash, "CENTRE_PAIRS", 10)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("gone", "id", "node", "whole", "key", "bands", "file_key", "row_index", "whole_row", "stay_row", "label", "fingerprint"):
        docs = docs.withColumn(c, F.lit("kept"))
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and {r.gone for r in kept.collect()} == {"kept"}
    assert sorted(((r.doc_id is None, r.doc_id) for r in kept.collect()), key=str) == sorted(brute_groups(rows), key=str)
    texts = [r.text for r in kept.where("doc_id = 2").collect()]
    assert sorted(texts) == ["same id, first text", "same id, other text entirely"]


def spliced(text, start, width, tag):
    """The words with a stretch of others in their place."""
    return [*text[:start], *(f"{tag}{i}" for i in range(width)), *text[start + width :]]


def test_copies_at_the_contract_are_found(spark):
    rows = []
    for k in range(60):  # 296 shingles each, 32 of them changed: 264 / 328 = 0.805
        first = [f"w{k}x{i}" for i in range(300)]
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(spliced(first, 100, 28, f"n{k}x")))]
    chain = [f"c{i}" for i in range(300)]  # 1001 is a copy of 1000 and of 1002, which are not copies of each other
    rows += [(1000, " ".join(spliced(chain, 50, 20, "p"))), (1001, " ".join(chain)), (1002, " ".join(spliced(chain, 200, 20, "q")))]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 120, 2), 1000]


def test_distinct_texts_with_equal_fingerprints_stay(spark):
    line = " ".join(f"l{i}" for i in range(7))
    repeated = [" ".join([line] * 200 + [f"{tag}{i}" for i in range(100)]) for tag in "ab"]
    first = [f"w{i}" for i in range(300)]
    rows = [(0, repeated[0]), (1, repeated[1]), (2, " ".join(first)), (3, " ".join(spliced(first, 100, 44, "n"))), (4, repeated[1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = by_id(simhash.fingerprints(docs))
    assert prints[0].fingerprint == prints[1].fingerprint
    assert simhash.similarity(*(rows[k][1].encode() for k in (0, 1))) < 0.1 and 0.7 < simhash.similarity(*(rows[k][1].encode() for k in (2, 3))) < 0.8
    assert sorted(r.doc_id for r in simhash.keep_representatives(docs).collect()) == [0, 1, 2, 3]


def test_block_links_are_exact():
    rng = np.random.default_rng(5)
    base = np.arange(100, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(100) < 0.12, rng.integers(1000, 9999, 100).astype(np.uint64), base)) for _ in range(60)]
    links = [(a, b) for a in range(60) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]

    def joined(pairs, label):
        label = list(label)
        for a, b in pairs:
            label = [label[b] if x == label[a] else x for x in label]
        return [[x == y for y in label] for x in label]

    known = list(range(60))
    for a, b in links[::7]:
        known = [known[b] if x == known[a] else x for x in known]
    main = max(set(known), key=known.count)
    found = simhash.block_links(sets, np.array(known), np.flatnonzero(np.array(known) != main), 0.8)
    assert {tuple(sorted(x, reverse=True)) for x in found} <= set(links)
    assert joined(found, known) == joined(links, range(60))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if passes(k, m.group())]


def test_pii(spark, docs, none):
    odd = ["a@b.c_x@y.z and a@b.c.d@e.f", "1.2.3.4.5.6.7.8 0300.1.1.1 00001.2.3.4", "+1 (((( 555-123-4567 )", "😀 4111 1111 1111 1111 4111111111111111", "call (310) 555-4510 or 00491701234567", "joe [at] mail [dot] example [dot] com", "9" * 2000, "a" * 2000 + "@b.co"]
    rng = random.Random(5)
    odd += ["".join(rng.choices("0123456789.@ab+-() _é", k=80)) for _ in range(200)]
    all_ = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = dict(all_.collect())
    got = pii.personal_data(all_).collect()
    assert len(got) == all_.count() and pii.personal_data(none).count() == 0
    for r in got:
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.strict] == base_spans(texts[r.doc_id])
    by = {r.doc_id: r.spans for r in got}
    assert any(not s.strict for s in by[104]) and any(not s.strict for s in by[105])
    plan = pii.candidates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_query(spark):
    texts = dict(scale.table(spark, SF, "documents").select("doc_id", "text").collect())
    for r in queries.op7_pii(spark, SF).collect():
        base = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_redact(docs):
    clean = by_id(pii.redact(docs))
    assert clean[13].text == "mail [EMAIL] or [PHONE], [IP], [CARD]" and clean[13].n_chars == len(clean[13].text)
    assert clean[0].text is None and clean[5].text == by_id(docs)[5].text


def test_stages_keep_columns_of_any_name(spark):
    """Each name that a stage uses within."""
    docs = scale.table(spark, SF, "documents")
    labels = scale.table(spark, SF, "labels")
    for c in ("toxicity", "is_toxic", "text_kept", "kind", "lot", "of", "whole_row", "pii", "pii_spans", "pii_strict", "pii_wide", "spans", "votes", "strict"):
        docs = docs.withColumn(c, F.lit("kept"))
    for got in (toxicity.remove_toxic(docs, labels), pii.redact(docs)):
        assert got.columns == docs.columns
        assert [tuple(r) for r in got.select(docs.columns[5:]).distinct().collect()] == [("kept",) * 14]


def test_em_trusts_the_reliable():
    good, bad = (0, (1, 1, 1, 1)), (0, (0, -1, -1, -1))
    chance = pii.estimate({good: 50, bad: 50, (0, (0, 1, 0, 1)): 5})
    assert chance[good] > 0.9 > 0.1 > chance[bad] and chance[0, (0, 1, 0, 1)] > 0.5


def test_language_id(spark, docs, none):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(scale.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    odd = by_id(langid.language_id(docs))
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2)) and odd[5].lang_pred in ("en", "fr")
    assert langid.language_id(none).count() == 0 and langid.language_id(docs).count() == docs.count()
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    keys, _ = langid.gram_keys([langid.letters("".join(rng.choice(list("abcd "), 30))) for _ in range(20)])
    grams, n = np.unique(keys, return_counts=True)
    model = langid.kneser_ney(["x"], np.zeros(len(grams), int), grams, n)
    for context in ("abc", "  a", "zzz", "bzd"):
        head = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context))
        all_ = np.array([head | ord(c) for c in " abcdΩ"], np.uint64)
        assert np.exp(model.log_chance(all_)).sum() == pytest.approx(1, abs=1e-5)


def test_kneser_ney_by_brute_force():
    rng = np.random.default_rng(4)
    texts = {"x": ["".join(rng.choice(list("abc "), 25)) for _ in range(12)], "y": ["".join(rng.choice(list("bcde "), 25)) for _ in range(12)]}
    grams = {k: collections.Counter(langid.gram_keys([langid.letters(t) for t in v])[0].tolist()) for k, v in texts.items()}
    rows = [(j, key, n) for j, k in enumerate("xy") for key, n in grams[k].items()]
    model = langid.kneser_ney(["x", "y"], *(np.array(c) for c in (list(zip(*rows))[0],)), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows]))

    def chance(counts, gram):
        """counts[n]: of n characters; the shorter ones count the different characters before them."""
        p = 1 / (len(counts[1]) + 1)
        for n in range(1, 5):
            own, context = gram[4 - n :], gram[4 - n : 3]
            after = {g: c for g, c in counts[n].items() if g[:-1] == context}
            if after:
                whole = sum(after.values())
                p = max(after.get(own, 0) - langid.DISCOUNT, 0) / whole + langid.DISCOUNT * len(after) / whole * p
        return p

    for j, k in enumerate("xy"):
        counts = {4: {tuple(key >> (16 * i) & 0xFFFF for i in (3, 2, 1, 0)): n for key, n in grams[k].items()}}
        for n in (3, 2, 1):
            counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
        tried = [*counts[4]][:40] + [tuple(map(ord, rng.choice(list("abcdz "), 4))) for _ in range(60)]
        keys = np.array([sum(c << (16 * (3 - i)) for i, c in enumerate(g)) for g in tried], np.uint64)
        assert np.exp(model.log_chance(keys)[:, j]) == pytest.approx([chance(counts, g) for g in tried], rel=1e-4)


def test_pfair_deviates_by_less_than_a_block():
    """Measured against the targets themselves, over several periods."""
    rng = random.Random(2)
    cases = [{"a": 0.9, "b": 0.1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"hot": 1 / 3} | {f"s{i}": 2 / 57 for i in range(19)}, {"a": 3, "b": 1}]
    cases += [{str(i): Fraction(rng.randint(1, 50)) for i in range(rng.randint(1, 12))} for _ in range(60)]
    for weights in cases:
        parts, period = mixing.exact_parts(weights)
        whole = sum(Fraction(w).limit_denominator(10**6) for w in weights.values())
        target = {k: Fraction(w).limit_denominator(10**6) / whole for k, w in weights.items()}
        served = dict.fromkeys(parts, 0)
        plan = mixing.lay_out(parts, period)
        for t in range(1, min(4 * period, 5_000) + 1):
            served[plan[(t - 1) % period]] += 1
            assert all(abs(served[k] - target[k] * t) < 1 for k in parts)


def test_parts_of_weights_without_a_short_period():
    weights = {f"s{i}": (i + 1) ** 0.5 for i in range(40)}
    parts, period = mixing.exact_parts(weights)
    assert period == mixing.MOST_SLOTS == sum(parts.values())
    assert all(abs(parts[k] - period * w / sum(weights.values())) < 1 for k, w in weights.items())
    tiny = mixing.whole_parts({"a": Fraction(97, 100), **{f"t{i}": Fraction(1, 1000) for i in range(30)}}, 64)
    assert sum(tiny.values()) == 64 and tiny["a"] == 34 and set(tiny.values()) == {34, 1}
    with pytest.raises(ValueError):
        mixing.exact_parts({"a": 0.0})


def test_mixing(spark, docs, none):
    weights = {"src0": 3.0, "src1": 1.0}
    rows = docs.select("doc_id", "source").collect()
    got = mixing.schedule(docs, weights, block_docs=2).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows))) and [r.slot for r in got] == sorted(r.slot for r in got)
    own = lambda s: s if s in weights else mixing.REST
    assert all(r.mix_source == own(r.source) for r in got) and sorted(map(str, [(r.doc_id, r.source) for r in got])) == sorted(map(str, [tuple(r) for r in rows]))
    # earliest deadline first among released blocks, slot by slot, over the targets 3/5, 1/5 and 1/5 of what has no weight
    target = {"src0": Fraction(3, 5), "src1": Fraction(1, 5), mixing.REST: Fraction(1, 5)}
    done, slots = dict.fromkeys(target, 0), collections.defaultdict(list)
    for t in range(200):
        ready = [k for k in target if math.floor(done[k] / target[k]) <= t]
        ends = {k: math.ceil((done[k] + 1) / target[k]) for k in ready}
        k = min(ready, key=lambda k: (ends[k], (done[k] + 1) / target[k] == ends[k], -target[k], k))
        slots[k].append(t)
        done[k] += 1
    assert all(slots[r.mix_source][r.block] == r.slot for r in got)
    assert collections.Counter((r.mix_source, r.block) for r in got).most_common(1)[0][1] == 2
    assert mixing.schedule(none, weights).count() == 0 and mixing.tempered_weights(none) == {}
    assert sorted(map(str, mixing.in_mix_order(docs, weights).collect())) == all_rows(docs)
    clash = docs.select("doc_id", "source", *[F.lit(1).alias(c) for c in ("mix_source", "block", "slot", "nth", "whole_row", "own_row", "number", "parts", "name", "turn", "at", "plan_source")])
    assert sorted(map(str, mixing.in_mix_order(clash, weights).collect())) == all_rows(clash)


def test_tempered_weights(spark):
    docs = spark.createDataFrame([("a",)] * 900 + [("b",)] * 99 + [(None,)], "source string")
    got = mixing.tempered_weights(docs)
    assert sum(got.values()) == 1 and set(got) == {"a", "b", ""}
    root = {"a": 900**0.5, "b": 99**0.5, "": 1.0}
    assert all(abs(got[k] - root[k] / sum(root.values())) < 1 / mixing.SLOTS for k in got)
    few = mixing.tempered_weights(docs, most=1)
    assert set(few) == {"a", mixing.REST} and few["a"] == 3 * few[mixing.REST]


def brute_packing(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            rooms.append((min(fits) if fits else capacity) - length)
            if fits:
                rooms.remove(min(fits))
    return sorted(rooms)


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([5, 16, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 10))}
        steps = packing.plan(counts, capacity)
        held = collections.defaultdict(list)
        for length, n in counts.items():
            own = [s for s in steps if s[0] == length]
            for k in range(n):
                _, first, per, sequence, offset = [s for s in own if s[1] <= k][-1]
                held[sequence + (k - first) // per].append((offset + (k - first) % per * length, length))
        for pieces in held.values():
            assert all(o == sum(n for p, n in pieces if p < o) for o, _ in pieces)
        assert sorted(capacity - sum(n for _, n in p) for p in held.values()) == brute_packing(counts, capacity)


def test_packing(docs, none):
    got = packing.pack(docs.unionByName(docs.where("doc_id = 5").withColumn("text", F.lit("a <|endoftext|> b")).withColumn("doc_id", F.lit(77).cast("long"))), TOKENIZER).toPandas()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()} | {77: tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids + [2]}
    for r in got.itertuples():
        own = ids[None if math.isnan(r.doc_id) else int(r.doc_id)]
        assert zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    assert got.length.sum() == sum(len(ids[r.doc_id]) for r in docs.collect()) + 2 * len(ids[77])
    assert packing.pack(none, TOKENIZER).count() == 0


def test_numbering_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    got = scale.number_within(df, ["k"], ["id"], "n", buckets=7).toPandas()
    assert all(sorted(g.n) == list(range(len(g))) for _, g in got.groupby("k", dropna=False))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (10, 11), (11, 12), (12, 13), (13, 14), (-5, 14)]
    got = {r.node: r.root for r in scale.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **dict.fromkeys([-5, 10, 11, 12, 13, 14], -5)}
    assert scale.components(spark.createDataFrame([], "u long, v long")).count() == 0
