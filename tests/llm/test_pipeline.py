"""The stages of the corpus pipeline against plain Python."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from logweave.llm import quality
from logweave.llm.tables import digit, shared_dir

STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(400)) for _ in range(n))


def texts_of(rng):
    shared, passage = "A line that many documents share, long enough", prose(rng, 40)
    out = [None, "", "short\nlines", "x", passage]
    for _ in range(30):
        base = [prose(rng, 12) for _ in range(6)]
        out.append("\n".join(base))
        kind = rng.randrange(6)
        if kind == 0:  # an exact copy with a heading of its own
            out.append("\n".join(["Title", *base]))
        elif kind == 1:  # a near copy in one line each
            words = " ".join(base).split()
            out += [" ".join(words), " ".join([*words[:-1], "other"])]
        elif kind == 2:
            out.append("\n".join([shared.upper() + " ", prose(rng, 30)]))
        elif kind == 3:
            out.append(prose(rng, 20) + " " + " ".join(passage.split()[5:17]).upper() + ", " + prose(rng, 20))
        elif kind == 4:
            out.append("BUY!!! NOW!!! ||| $$$ " * rng.randrange(3, 40))
        else:
            out.append(prose(rng, rng.randrange(1, 9)))
    return out, passage


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(12)
    texts, passage = texts_of(rng)
    folder = f"{shared_dir(spark)}"
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or ""), "extra", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, `_text` string, `a.b` long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, prose(rng, 30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int("BUY" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {i: t for i, t in enumerate(texts)}, passage


def run(spark, tables, name, extra=None):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    docs = docs if extra is None else extra(docs)
    out = STAGES[name](spark, docs, tables[0])
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r["_text"] == "extra" and r["a.b"] == r.doc_id for r in rows)
    return rows


def key(line):
    k = line.strip(" \t\n\r\x0b\x0c").lower()
    return k if len(k) >= 10 else None


def test_quality(spark, tables):
    """The densities by plain inversion of the shrunken covariances."""
    folder, texts, _ = tables
    held = {r.doc_id for r in spark.range(len(texts)).select(F.col("id").alias("doc_id")).where(digit() == 0).collect()}
    known = {i: int("BUY" not in (texts[i] or "")) for i in texts if i % 2 and i not in held}
    x = np.concatenate(list(quality.statistics(pa.array([texts[i] for i in sorted(texts)], pa.string()))))
    own = x[sorted(known)]
    y = np.array([known[i] for i in sorted(known)])
    spread = np.where(own.std(0) > 1e-9, own.std(0), 1.0)
    z, all_ = (own - own.mean(0)) / spread, (x - own.mean(0)) / spread
    pooled = sum(((z[y == c] - z[y == c].mean(0)).T @ (z[y == c] - z[y == c].mean(0))) for c in (0, 1)) / len(z)
    logs = []
    for c in (0, 1):
        part = z[y == c]
        cov = (1 - quality.TO_POOLED) * np.cov(part.T, bias=True) + quality.TO_POOLED * pooled
        cov = (1 - quality.TO_SPHERE) * cov + quality.TO_SPHERE * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-6 * np.eye(len(cov))
        away = all_ - part.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) - 0.5 * np.linalg.slogdet(cov)[1])
    odds = np.log((y == 1).sum() / (y == 0).sum())
    score = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / quality.TEMPER + odds, -500, 500)))
    assert {r.doc_id for r in run(spark, tables, "quality classifier")} == {i for i in texts if score[i] >= corpus_pipeline.LEAST_QUALITY}


def test_line_dedup(spark, tables):
    _, texts, _ = tables
    first = {}
    for i in sorted(texts):
        for k in map(key, (texts[i] or "").split("\n")):
            if k:
                first.setdefault(k, i)
    want = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) is None or first[key(x)] == i]
        if len(stay) == len(lines) or any(key(x) for x in stay):
            want[i] = None if t is None else "\n".join(stay)
    rows = run(spark, tables, "line dedup")
    assert {r.doc_id: r.text for r in rows} == want and any(i not in want for i in texts)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_near_copies(spark, tables):
    _, texts, _ = tables

    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    low = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in range(i):
                if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    want = sorted(i for i in texts if low[i] == i)
    assert sorted(r.doc_id for r in run(spark, tables, "n-gram Jaccard join")) == want != sorted(texts)
    # Rows that repeat with their id: one of them stays.
    assert sorted(r.doc_id for r in run(spark, tables, "n-gram Jaccard join", lambda d: d.unionAll(d))) == want


def test_decontamination(spark, tables):
    _, texts, passage = tables
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    own = split(passage)
    runs = {tuple(own[i:i + 10]) for i in range(len(own) - 9)}
    dirty = {i for i, t in texts.items() if any(tuple(split(t)[a:a + 10]) in runs for a in range(len(split(t)) - 9))}
    assert len(dirty) > 3 and {r.doc_id for r in run(spark, tables, "benchmark decontamination")} == set(texts) - dirty


def test_tokens(spark, tables):
    folder, texts, _ = tables
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = STAGES["byte-level BPE"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    for r in out.collect():
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_encoding_and_decoding_are_not_in_one_stage(spark, tables):
    """A core would have a Python process for each of them."""
    out = STAGES["byte-level BPE"](spark, spark.read.parquet(f"{tables[0]}/documents.parquet"), tables[0])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_run_is_its_stages_one_after_the_other(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect())) and whole.count()


@pytest.mark.parametrize("name", STAGES)
def test_stages_stand_empty_tables_and_rows_without_ids(spark, tables, name):
    folder = tables[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0
    odd = docs.limit(3).unionAll(docs.limit(4).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("unlike all others "), F.uuid())))
    assert STAGES[name](spark, odd, folder).count() >= 4
