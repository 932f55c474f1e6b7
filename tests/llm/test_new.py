"""Sharding, whitening and lexical search against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import lexical_search, sharding, whitening
from logweave.llm.tables import carried, shared_dir

ODD = [None, "", "  ", "...", "x", "It's we'll I'D", "x\x1cy\x85z　w", "漢字かな混じり文、" * 40, "a" * 5000, "é. É, x...y!!", "long line here now\n" * 2000]
CLASH = "doc_id long, text string, source string, `a.b` string, Text2 string, hash string, STRATUM string, place long, `_salt` string, id string, vector string, c0 string"


# --- sharding ---

def shard_by_hand(rows, shards, seed=sharding.SEED):
    """(doc_id, source) -> (shard, slot), by one sort of everything; ids are unique."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    text = lambda v: "" if v is None else f"={v}"
    by = {}
    for doc, source in rows:
        by.setdefault(text(source), []).append((md5(f"{seed}:{text(doc)}"), doc, source))
    placed = []
    for stratum, own in by.items():
        offset = int(md5(f"{seed}:source:{stratum}")[:8], 16) / 2**32
        placed += [((r + offset) / len(own), stratum, h, doc, source) for r, (h, doc, source) in enumerate(sorted(own, key=lambda x: x[0]))]
    out, n = {}, len(rows)
    for p, (_, _, _, doc, source) in enumerate(sorted(placed, key=lambda x: x[:3])):
        shard = p * shards // n
        out[doc, source] = shard, p - -(-shard * n // shards)
    return out


def some_rows(rng, n):
    return [(i, "hot" if rng.random() < 0.4 else rng.choice([None, "", "a", "b", f"rare{i}"])) for i in range(n)]


@pytest.mark.parametrize("n,shards,buckets,split", [(700, 40, 50, 10**6), (700, 7, 20_000, 10**6), (13, 40, 3, 10**6), (1, 3, 10, 10**6), (400, 8, 100, 3)])
def test_shards_are_those_of_one_sort(spark, n, shards, buckets, split):
    rows = some_rows(random.Random(n), n)
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, source string").repartition(5), shards, bucket_rows=buckets, split_rows=split).collect()
    by = {(r.doc_id, r.source): (r.shard, r.slot) for r in got}
    counts = Counter(r.shard for r in got)
    assert len(by) == len(got) == n
    assert max(counts.get(s, 0) for s in range(shards)) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s, own in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(own))
    if split > n:  # buckets that are split have an order of their own
        assert by == shard_by_hand(rows, shards)
    for source, own in Counter(r.source for r in got).items():  # every shard has its part of the source
        parts = Counter(r.shard for r in got if r.source == source)
        assert all(abs(parts.get(s, 0) - own / shards) <= 3 for s in range(shards))


def test_shards_of_rows_that_repeat(spark):
    """A third of all rows is one and the same row."""
    rows = [(1, "t", "s")] * 300 + [(None, f"n{i}", None) for i in range(300)] + [(i, "x", "s") for i in range(2, 302)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), 9, bucket_rows=100, split_rows=20)
    assert Counter(tuple(r) for r in out.select("doc_id", "text", "source").collect()) == Counter(rows)
    assert sorted((r.shard, r.slot) for r in out.collect()) == [(s, i) for s in range(9) for i in range(100)]
    for r in out.groupBy("source", "shard").count().collect():
        assert abs(r["count"] - (600 if r.source else 300) / 9) <= 2


def test_shards_keep_columns_and_stand_empty_tables(spark):
    rows = [(i, t, "s", "dot", "T", "h", "st", i, "salt", "id", "v", "c") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, CLASH).withColumn("SHARD", F.lit("mine"))
    out = sharding.assign_shards(df, 3)
    assert out.columns == [*df.columns[:-1], "shard", "slot"]
    assert sorted(tuple(r)[:12] for r in out.collect()) == rows
    assert sharding.assign_shards(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="no column"):
        sharding.assign_shards(df.drop("source"), 3)


def test_shard_files(spark):
    folder = f"{shared_dir(spark)}/shards"
    rows = some_rows(random.Random(9), 200)
    sharding.write_shards(sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, source string"), 4), folder, file_rows=20)
    back = spark.read.parquet(folder)
    assert sorted((r.shard, r.slot) for r in back.collect()) == [(s, i) for s in range(4) for i in range(50)]
    firsts = back.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.collect_list("slot").alias("slots")).collect()
    assert len(firsts) >= 4 and all(r.slots == sorted(r.slots) for r in firsts)


def test_the_main_path_of_sharding_is_native(spark):
    plan = sharding.assign_shards(spark.createDataFrame([(1, "a")], "doc_id long, source string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


# --- whitening ---

def spectrum(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * np.array(values, float)) @ q.T
    return (a + a.T) / 2


CASES = {
    "even": np.linspace(5, 1, 30), "falling": np.logspace(0, -6, 64), "steep": np.logspace(0, -13, 40), "equal": np.ones(20), "two levels": [1.0] * 20 + [0.0] * 20,
    "clusters": [5, 5, 5, 3, 3, 3] + [1] * 12 + [0.5] * 20, "near": [1e6] + [1 + 1e-9 * i for i in range(30)], "low rank": [3, 2, 1] + [0] * 9, "one": [2.0], "two": [3.0, 1.0], "pairs": [4, 4, 2, 2, 1, 1, 0.5, 0.5, 0.25, 0.25],
}


@pytest.mark.parametrize("name", CASES)
def test_components_are_those_of_a_dense_solver(name):
    rng = np.random.default_rng(3)
    cov = spectrum(rng, CASES[name])
    values, vectors = whitening.components(cov, 8)
    want = np.linalg.eigvalsh(cov)[::-1]
    assert len(values) == min(8, int((want > 1e-12 * want[0]).sum()))
    np.testing.assert_allclose(values, want[:len(values)], atol=1e-13 * want[0])
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    np.testing.assert_allclose(cov @ vectors, vectors * values, atol=1e-12 * want[0])


def test_inertia_counts():
    rng = np.random.default_rng(5)
    a = spectrum(rng, rng.standard_normal(25))
    diagonal, off = whitening.tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    shifts = np.linspace(-3, 3, 50)
    np.testing.assert_array_equal(whitening.count_above(diagonal, off, shifts), [(values > s).sum() for s in shifts])
    with pytest.raises(ArithmeticError):  # an interval that holds fewer than it is said to
        whitening.feast(np.diag([3.0, 2.0, 1.0]), 1.5, 2.5, 2)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((90, 12)) * np.linspace(2, 0.2, 12) + 3
    rows = [(i, [float(x) for x in v], f"t{i}", "w") for i, v in enumerate(good)]
    rows += [(0, rows[0][1], "again", "w"), (None, rows[1][1], "no id", "w")]
    odd = [(900, None, "", ""), (901, [], "", ""), (902, [float("nan")] * 12, "", ""), (903, [None, *[1.0] * 11], "", ""), (904, [1.0, float("inf"), *[1.0] * 10], "", ""), (905, [1.0, 2.0], "", "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, `a.b` string, Whitened string").repartition(4)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "a.b", *whitening._RESULTS]
    x = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    cov = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = (x - sums / n) @ axes / np.sqrt(values)
    got = {(r[0], r[1], r.component): r for r in out.collect()}
    assert len(got) == 8 * n
    for i, (vec, _, tag, _) in enumerate(rows):
        for c in range(8):
            r = got[vec, tag, c + 1]
            sign = np.sign(got[rows[0][0], rows[0][2], c + 1].whitened * want[0, c])
            assert r.n == n and r.deviation == int(((n * x[i] - sums) ** 2).sum()) and r.identity_error < 1e-9
            assert abs(r.whitened - sign * want[i, c]) < 1e-9 and abs(r.explained - values[c] / np.trace(cov)) < 1e-12
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_of_vectors_without_spread(spark):
    make = lambda vs: spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<float>")
    assert whitening.whiten(make([[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whiten(make([[1.0, 2.0]])).count() == 0
    line = whitening.whiten(make([[float(i), 2.0 * i, 0.0] for i in range(6)]))
    assert {r.component for r in line.collect()} == {1} and line.count() == 6
    # Beyond a long: entries count as at most 2^40, and the deviation may be null.
    huge = whitening.whiten(make([[3e38, 1.0], [-3e38, 2.0], [0.0, 5.0]])).collect()
    assert len(huge) == 3 and {r.deviation is None for r in huge} == {True, False}
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(make([[0.0] * (whitening.WIDEST + 1)]))


# --- lexical search ---

def terms(text):
    return [w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]


def rank_by_hand(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    held = Counter(t for _, c in own for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = set()
    for item, counts in asked.items():
        scores = []
        for doc, c in own:
            if c:
                m = 25 + 75 * sum(c.values()) * n_docs // n_terms
                s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in counts.items() if c[t])
                if s > 0:
                    scores.append((-s, doc is None, doc if doc is not None else 0, doc))
        out |= {(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])}
    return out


def corpus(rng, n):
    words = [f"w{i}" for i in range(200)] + ["Grüße", "x", "42", "漢字"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(n)]


@pytest.mark.parametrize("k", [1, 10])
@pytest.mark.parametrize("items_each", [lexical_search.BLOCK_ITEMS, 4])
def test_search_ranks_as_all_exact_scores_do(spark, monkeypatch, k, items_each):
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", items_each)
    rng = random.Random(k)
    texts = ODD + corpus(rng, 150)
    texts += [texts[40]] * 30 + [" ".join(corpus(rng, 40))]
    docs = list(enumerate(texts)) + [(20, texts[20]), (20, "w3 w3 w150"), (None, texts[40]), (None, texts[41])]
    items = [(i, t) for i, t in enumerate(corpus(rng, 12))] + [(50, texts[40].upper()), (51, None), (52, ""), (53, "unheard of"), (None, "w1 w1 w1 Grüße w199"), (3, "w7 w8"), (3, "w7 w8"), (60, "x42 漢字")]
    out = lexical_search.rank_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len({g[:2] for g in got}) and set(got) == rank_by_hand(docs, items, k)


def test_bounds_hold_and_exclude(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame(list(enumerate(corpus(rng, 400))), "doc_id long, text string").coalesce(1)
    rows = lexical_search.build_index(docs).collect()
    assert sum(len(r.ids) for r in rows) == 400
    hashed = {t: h for _, _, hs, f in lexical_search._hashed(pa.array([" ".join(f"w{i}" for i in range(200))])) for t, h in zip((f"w{i}" for i in range(200)), hs.tolist())}
    counts = {r.doc_id: Counter(terms(r.text)) for r in docs.collect()}
    held = Counter(t for c in counts.values() for t in c)
    n_terms = sum(sum(c.values()) for c in counts.values())
    asked = [["w150", "w60", "w60"], ["w0", "w5", "w180"]]
    block = lexical_search._Block([[hashed[t] for t in a] for a in asked], sum(bool(c) for c in counts.values()), n_terms, {hashed[t]: n for t, n in held.items() if t in hashed})
    over = exact = 0
    for r in rows:
        for a, top in block.bounds(np.array(r.sizes), r.width, r.slices):
            for i, doc in enumerate(r.ids[a:a + top.shape[1]]):
                m = 25 + 75 * sum(counts[doc].values()) * block.docs // n_terms
                for q, own in enumerate(asked):
                    score = sum(math.floor(1000 * math.log((2 * block.docs + 2) / (2 * held[t] + 1))) * (10**9 * counts[doc][t] // (1000 * counts[doc][t] + 8 * m)) for t in own if counts[doc][t])
                    assert top[q, i] >= score
                    over, exact = over + (top[q, i] > score), exact + (top[q, i] == score)
    assert exact > 3 * over


def test_search_over_odd_tables(spark):
    docs = spark.createDataFrame([(str(i), t, "x", "y") for i, t in enumerate(ODD)], "Doc_ID string, text string, `a.b` string, score string")
    items = spark.createDataFrame([("q", "x y we ll", 1)], "item_id string, text string, rank int")
    out = lexical_search.rank_documents(docs, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 4
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("Doc_ID = 0"), items)):
        none = lexical_search.rank_documents(d, i)
        assert none.count() == 0 and dict(none.dtypes) == {"item_id": "string", "rank": "int", "doc_id": "string", "score": "bigint"}


def test_carried_columns_come_back(spark):
    df = spark.range(2).selectExpr("id", "id as `a.b`", "id as ID2", "id as `x``y`").withColumn("Result", F.lit(1))
    inner, back, (key,) = carried(df, ("result",), "A.B", gone=("id2",))
    assert inner.columns == ["c0", "c1", "c2", "c3", "c4"] and key == "c1"
    assert back(inner.withColumn("result", F.lit(5))).columns == ["id", "a.b", "x`y", "result"]
