"""The text operators against plain Python, on small tables with nulls, ties, copies and clashing names."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from logweave.llm import byte_bpe, decontaminate, embedding_dups, jaccard_join, language_id, license_scan, line_dedup, quality, token_files, toxicity
from logweave.llm.tables import components, may_be_among, sample_rows, shared_dir

ODD = [None, "", "  ", "\n\n", "x", "It's we'll I'D", "x\x1cy\x85z　w", "漢字かな混じり文、" * 40, "a" * 5000, "<|endoftext|> Ab.", "é. É, x...y!!", "long line here now\n" * 2000]
SCHEMA = "doc_id long, text string, kept string, ids string, n_words string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark, texts, extra=()):
    rows = [(i, t, "own", None, "clash") for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def some_words(rng, n):
    return [rng.choice(["the", "and", "Alpha", "beta", "gamma"]) + str(rng.randrange(60)) for _ in range(n)]


def key(line):
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))
    return k if len(k) >= 10 else None


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = ["A shared line, long", "another shared LINE ", "short", "ten chars!", "Grüße aus Köln"]
    texts = ODD + ["\n".join(rng.choice([*pool, *(x.upper() for x in pool), " ".join(some_words(rng, 4))]) for _ in range(6)) for _ in range(40)]
    first = {}
    for i, t in enumerate(texts):
        for k in map(key, (t or "").split("\n")):
            if k:
                first.setdefault(k, i)
    out = line_dedup.dedup_lines(table(spark, texts, [(None, "A shared line, long", "", "", "")])).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        if r.doc_id is None:
            assert (r.n_dropped, r.kept) == (0, "A shared line, long")
            continue
        lines = (texts[r.doc_id] or "").split("\n")
        stay = [x for x in lines if key(x) is None or first[key(x)] == r.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_lines_of_few_rows_stay(spark):
    texts = ["a line that two hold\na line that three hold", "A line that two hold\na line that THREE hold", "a line that three hold"]
    kept = lambda least: [r.n_dropped for r in line_dedup.dedup_lines(table(spark, texts), least_rows=least).orderBy("doc_id").collect()]
    assert kept(2) == [0, 2, 1] and kept(3) == [0, 1, 1] and kept(4) == [0, 0, 0]


def test_a_hot_line_copies_its_shard_alone(spark, monkeypatch):
    """A line in all documents: of the shards only its own is copied, once for each of its salts."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "PROBE_ROWS", 100)
    texts = ["\n".join(["the line that all documents hold", f"shared by two documents {i // 2}", f"own line of document {i}"]) for i in range(400)]
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table(spark, texts)).collect()} == {i: int(i > 0) + i % 2 for i in range(400)}
    lines = spark.range(1000).select(F.when(F.col("id") < 900, 3).otherwise(F.col("id") % 10).alias("h"))
    salts = {r.shard: r.salts for r in line_dedup.salts_by_shard(lines, F.col("h")).collect()}
    assert salts == {i: 10 if i == 3 else 1 for i in range(10)}


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 50_000, dtype=np.uint64))
    slot, levels, rest = line_dedup.build_index(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    assert (line_dedup.find(keys, levels, rest) == slot).all()


def sets_of(texts, k):
    out = []
    for t in texts:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("k,num,den,chunk", [(3, 9, 10, 1500), (5, 4, 5, 1500), (3, 9, 10, 6)])
def test_jaccard_join_loses_no_link(spark, monkeypatch, k, num, den, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_DOCS", chunk)
    rng = random.Random(k)
    texts = [t for t in ODD if t is None or len(t) < 500]
    for size in (3, 9, 30, 80, 200):
        for _ in range(4):
            base = some_words(rng, size)
            for _ in range(8):
                own = list(base)
                for _ in range(rng.randrange(0, max(1, size // 20) + 1)):
                    own[rng.randrange(size)] = "z" + str(rng.randrange(9999))
                texts.append(" ".join(own if rng.random() < 0.8 else [x.upper() for x in own]))
    sets = sets_of(texts, k)
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    out = {r.doc_id: r for r in jaccard_join.similar_documents(table(spark, texts), k, num, den).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert jaccard_join.similar_documents(table(spark, []), k, num, den).count() == 0


def hashed_sets(rng, base, n):
    """Sets near ``base``: some of its elements exchanged for others."""
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(0, max(1, len(base) // 10) + 1)):
            own[rng.randrange(len(own))] = rng.getrandbits(64)
        out.append(np.unique(np.array(own, np.uint64)))
    return out


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5)])
def test_linked_sets_share_a_signature(num, den):
    rng = random.Random(num)
    maker, straddled = jaccard_join.Signatures(num, den), 0
    for _ in range(400):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 5, 20, 60, 150]))]
        sets = hashed_sets(rng, base, 5)
        # So many common shingles that what is left lies about the border, and some that not all sets hold.
        common = np.unique(np.array([x for x in base if rng.random() < rng.choice([0.3, 0.6, 0.8, 0.95])] + [rng.getrandbits(64)], np.uint64))
        own = [set(maker.of(s, common).tolist()) for s in sets]
        few = [any(maker._family(np.setdiff1d(s, common), c, parts, spare, low, 1)[0] for c, _, parts, spare, low in maker.classes(len(s))) for s in sets]
        for i, j in ((i, j) for i in range(5) for j in range(i)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                assert own[i] & own[j]
                straddled += few[i] != few[j]
    assert straddled > 20


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5)])
def test_jaccard_join_with_common_shingles(spark, monkeypatch, num, den):
    monkeypatch.setattr(jaccard_join, "COMMON_LEAST", 8)
    monkeypatch.setattr(jaccard_join, "COMMON_SHARE", 1, raising=False)
    rng = random.Random(num)
    pool = [f"s{i}" for i in range(400)]
    texts = []
    for _ in range(400):  # pairs, of which 5 to 70 % of the words are their own and the others common
        size, own = rng.choice([20, 40, 60, 90]), rng.choice([0.05, 0.15, 0.3, 0.5, 0.7])
        base = [f"u{rng.randrange(10**9)}" if rng.random() < own else x for x in rng.sample(pool, size)]
        for _ in range(2):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, size // 20) + 1)):
                copy[rng.randrange(size)] = f"z{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    sets = sets_of(texts, 1)
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    for i, j in links:
        label[i] = label[j]
    assert links and all(i == j + 1 for i, j in links)
    out = {r.doc_id: r.component_id for r in jaccard_join.similar_documents(table(spark, texts), 1, num, den).collect()}
    assert out == dict(enumerate(label))


@pytest.mark.parametrize("n", [33, 40, 300, 3000])
@pytest.mark.parametrize("linked", [0, 2])
def test_sets_of_which_no_nodes_can_link(n, linked):
    """Sets that share too little for a pair: the walk ends above the leaves. Some copies, and it goes on."""
    rng = np.random.default_rng(n)
    sets = [np.unique(np.append(rng.integers(1 << 32, 1 << 63, 60, dtype=np.uint64), np.uint64(i % 5))) for i in range(n)]
    for i in range(linked):
        sets[n - 1 - i] = np.append(sets[i][:-1], np.uint64(1 << 63))
    for side in (None, np.arange(n) < n // 2):
        classes = jaccard_join.Classes(n)
        jaccard_join.join_sets(sets, 4, 5, classes, side)
        assert [classes.root(i) for i in range(n)] == [*range(n - linked), *range(linked)[::-1]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (100, 101)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_rows_that_may_be_among_keys(spark):
    rows = spark.range(20_000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    keys = spark.range(0, 20_000, 100)
    out = {r.id: r.text for r in may_be_among(rows, keys, "id").collect()}
    assert set(range(0, 20_000, 100)) <= out.keys() and len(out) < 3000 and out[100] == "text 100"
    assert may_be_among(rows, keys.limit(0), "id").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 16))
    x = np.concatenate([x, x[:20] + rng.standard_normal((20, 16)) * 0.05, x[:5], x[:5] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None, *[1.0] * 15]), (905, [1.0, 0.0]), (None, x[0].tolist())]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(close, low[None, :], len(x)).min(1))
    out = {r.vec_id: r for r in embedding_dups.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(out) == len(rows)
    assert [(out[i].n_links, out[i].component_id, out[i].kept) for i in range(len(x))] == [(int(close[i].sum()), low[i], low[i] == i) for i in range(len(x))]
    assert all((out[i].n_links, out[i].component_id) == (0, i) for i in range(900, 906))


@pytest.mark.parametrize("cosine", [0.9, 0.8])
def test_pairs_just_at_the_cosine_meet(cosine):
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((2, 2000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    tables = embedding_dups.Tables(*embedding_dups.plan(1000, cosine))
    met = sum(int((tables.keys(x[i:i + 200]) == tables.keys(y[i:i + 200])).any(1).sum()) for i in range(0, 2000, 200))
    assert met >= 1990


def test_byte_bpe_is_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY[0], "rb"))}
    own = tiktoken.Encoding("own", pat_str=VOCABULARY[1], mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ODD + ["".join(chr(rng.randrange(32, 0x3000)) for _ in range(300)) for _ in range(20)] + ["".join(rng.choice("abcde") for _ in range(999))]
    out = byte_bpe.decode(byte_bpe.encode(table(spark, texts), *VOCABULARY), *VOCABULARY).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for r in out:
        text = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    folder = f"{shared_dir(spark)}/tokens"
    token_files.write_tokens(table(spark, ODD), folder, path, parts=4)
    start = 0
    out = {r.doc_id: r for r in token_files.with_crc32(token_files.read_tokens(spark, folder)).collect()}
    for i, t in enumerate(ODD):
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    plan = token_files.read_tokens(spark, folder, ("doc_id", "n_tokens")).where("doc_id = 3")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,3)" in plan and "ids" not in plan.split("ReadSchema")[-1]


def test_decontamination(spark, monkeypatch):
    rng = random.Random(5)
    items = [some_words(rng, n) for n in (30, 25, 12, 10, 4, 1, 0)] + [["shared"] + some_words(rng, 14)]
    docs = []
    for _ in range(40):
        w = some_words(rng, rng.randrange(0, 60))
        if rng.random() < 0.6:
            item = rng.choice(items)
            a = rng.randrange(len(item) + 1)
            w[5:5] = item[a:a + rng.choice([9, 10, 15, 40])]
        docs.append(", ".join(w))
    docs += [None, "", "..", " ".join(items[0]).upper()]
    bench = spark.createDataFrame([(f"i{i}", " ".join(w)) for i, w in enumerate(items)] + [(None, "x y"), ("n", None)], "item_id string, text string")
    split = lambda t: [w.lower() for w in (t or "").replace(",", " ").replace(".", " ").split()]
    for few in (decontaminate.FEW_DOCS, 0):
        monkeypatch.setattr(decontaminate, "FEW_DOCS", few)
        for r in decontaminate.find_passages(table(spark, docs), bench).collect():
            w, hit, found = split(docs[r.doc_id]), set(), set()
            for i, item in enumerate(items):
                item = [x.lower() for x in item]
                n = min(len(item), 10)
                for a in range(len(item) - n + 1 if n else 0):
                    for at in range(len(w) - n + 1):
                        if w[at:at + n] == item[a:a + n]:
                            hit |= set(range(at, at + n))
                            found.add(f"i{i}")
            assert (r.n_words, r.hit_words, r["items"]) == (len(w), sorted(hit), sorted(found))


def test_repeated_item_ids_count_once(spark):
    bench = spark.createDataFrame([("a", "one two three"), ("a", "four five six"), ("a", "one two three"), ("b", "four five six")], "item_id string, text string")
    docs = table(spark, ["x one two three y four five six", "four five six", "one two"])
    out = {r.doc_id: (r.hit_words, r["items"]) for r in decontaminate.find_passages(docs, bench).collect()}
    assert out == {0: ([1, 2, 3, 5, 6, 7], ["a", "b"]), 1: ([0, 1, 2], ["a", "b"]), 2: ([], [])}


def test_many_items_take_one_scan_of_the_documents(spark):
    """300,000 item windows: the driver has a bitmap, the tasks no items."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(5000)]
    items = [(f"i{n}", " ".join(rng.choices(words, k=310))) for n in range(1000)]
    docs = [" ".join(rng.choices(words, k=50)) + " " + " ".join(items[n][1].split()[n % 300:n % 300 + 9 + n % 3]) for n in range(60)]
    out = {r.doc_id: (r.n_words, len(r.hit_words), r["items"]) for r in decontaminate.find_passages(table(spark, docs), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert out == {n: (59 + n % 3, 0 if n % 3 == 0 else 9 + n % 3, [] if n % 3 == 0 else [f"i{n}"]) for n in range(60)}
    bitmap, sizes = decontaminate._bitmap(spark.createDataFrame([(10, i * 7919) for i in range(3000)], "size int, print long"))
    assert len(bitmap) * 8 == 65536 and sizes == [10] and 2800 < np.unpackbits(bitmap).sum() <= 3000


def test_license_scan(spark):
    grant = license_scan.TEMPLATES[4][1]
    whole = next(t for n, t in license_scan.TEMPLATES if n == "MIT" and len(t) > 900)
    header = " */\n\n * ".join(grant[i:i + 60] for i in range(0, len(grant), 60))
    texts = [
        "x y z\nLicensed under the Apache License, Version 2.0.\nmore", "released UNDER the mit license", "Permission is hereby granted", None, "", "license", grant.replace(", ", ",\n"),
        "It is free to use. Licensed under the Apache License, Version 2.0. Contact us for more.", "# SPDX-License-Identifier: Apache-2.0\nimport os", "/*\n * " + header.replace("Soft */\n\n * ware", "Software"),
        "before " + whole + " after", "// SPDX-License-Identifier: MIT\n" + "code " * 500 + "\nReleased under the MIT License.", "SPDX-License-Identifier: WTFPL", "the license of the software and of the work is in the files under the terms " * 50]
    out = {r.doc_id: [n.license for n in r.notices] for r in license_scan.scan_licenses(table(spark, texts)).collect()}
    assert out == {0: ["Apache-2.0"], 1: ["MIT"], 2: [], 3: [], 4: [], 5: [], 6: ["MIT"], 7: ["Apache-2.0"], 8: ["Apache-2.0"], 9: ["MIT"], 10: ["MIT"], 11: ["MIT", "MIT"], 12: [], 13: []}
    spans = {r.doc_id: [texts[r.doc_id][n.start:n.end] for n in r.notices] for r in license_scan.scan_licenses(table(spark, texts)).collect()}
    assert spans[7] == ["Licensed under the Apache License, Version 2.0"] and spans[10][0].startswith("Permission is") and spans[10][0].endswith("OTHER DEALINGS IN")


def test_license_scan_compares_all_stretches(spark):
    """Every stretch of every text with every template, and the same choice of those that overlap."""
    rng = random.Random(11)
    templates = [("A", "one two three four five"), ("B", "two three four six seven eight nine"), ("C", "one two one two one"), ("D", "ten"), ("E", "three four")]
    words = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "zero"]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.4 else w for w in (rng.choice(templates)[1] + " " + rng.choice(templates)[1] + " x " * rng.randrange(3)).split()) for _ in range(150)]
    pairs = lambda w: list(zip(w, w[1:]))
    least = 0.7
    out = {r.doc_id: [(n.license, round(n.dice, 9), texts[r.doc_id][n.start:n.end]) for n in r.notices] for r in license_scan.scan_licenses(table(spark, texts), templates, least).collect()}
    for d, text in enumerate(texts):
        own, found = pairs(text.split()), []
        for name, t in templates:
            grams = pairs(t.split())
            for i in range(len(own)):
                for j in range(i, min(len(own), i + int(len(grams) * (2 - least) / least + 1e-9))):
                    both, here = len(set(own[i:j + 1]) & set(grams)), len(set(own[i:j + 1]))
                    if both >= least * len(set(grams)) and 2 * both >= least * (here + len(set(grams))):
                        found.append((-both, -2 * both / (here + len(set(grams))), name, i, j))
        kept = []
        for f in sorted(found):
            if all(f[4] + 1 < k[3] or f[3] > k[4] + 1 for k in kept):
                kept.append(f)
        assert out[d] == [(f[2], round(-f[1], 9), " ".join(text.split()[f[3]:f[4] + 2])) for f in sorted(kept, key=lambda f: f[3])]


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    from logweave.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    lang = QUERIES["op1_language_id"](spark, sf).where("held_out").join(docs, "doc_id")
    assert lang.where("lang = lang_pred").count() >= 0.98 * lang.count()
    good = QUERIES["op6_quality"](spark, sf).where("held_out").join(labels, "doc_id")
    assert good.where("quality = predicted").count() >= 0.95 * good.count()
    toxic = QUERIES["op7_toxicity"](spark, sf).join(labels.withColumnRenamed("toxic", "truth"), "doc_id")
    assert toxic.where("(truth = 1) = toxic").count() >= 0.9 * toxic.count()


def test_too_many_labels_fail(spark):
    rows = spark.range(1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.least("id", F.lit(1000))).alias("lang"), F.lit("some text").alias("text"))
    with pytest.raises(ValueError, match="labels"):
        language_id.fit_languages(rows)
    most = sample_rows(rows.where("doc_id < 1000"), "lang", 5).select("lang").distinct().count()
    assert most == 1000


def test_models_on_odd_and_empty_tables(spark):
    docs = table(spark, ODD)
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language_id.predict_languages(docs, language_id.fit_languages(none.withColumn("lang", F.lit("x")))).where("lang_pred = 'und' and score = 0").count() == len(ODD)
    kernel = language_id.Kernel.fit(["der und die das", "the and of it"] * 3, ["de", "en"] * 3)
    got = {r.doc_id: r.lang_pred for r in language_id.predict_languages(docs, kernel).collect()}
    assert [got[i] for i in range(4)] == ["und"] * 4
    assert quality.score_quality(docs, quality.fit_quality(docs, labels)).where("score = 0.5").count() == len(ODD)
    assert toxicity.score_severity(docs, toxicity.fit_severity(docs, labels)).where("grade = 0").count() == len(ODD)
    model = toxicity.Ordinal.fit([np.array(sorted({g * 10, 5 + (i % 3)}), np.uint64) for i in range(60) for g in (0, 1, 2)], np.array([0, 1, 2] * 60))
    assert (np.diff(model.thresholds) > 0).all()
    severity = model.over([np.array([g * 10], np.uint64) for g in (0, 1, 2)]).sum(1)
    assert severity[0] < severity[1] < severity[2]


def hostile(rng, n):
    signs = ["a", "Z", "é", "É", "ß", "İ", "ς", "Σ", ".", ",", "'", "'s", "'LL", "!", "1", "٣", " ", "\n", "\t", "\x85", "\x1c", "　", "漢", "́", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "-", "$", "_", "​", "🙂"]
    return ["".join(rng.choices(signs, k=rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("words", [token_files.CACHE_WORDS, 5])
def test_word_encoder_is_the_library(monkeypatch, words):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_WORDS", words)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
    texts = hostile(random.Random(7), 3000) + ["", "x" * 100_000, "word " * 50_000]
    for closing in ((), (1,), (7, 8)):
        at = 0
        for first, last, sizes, flat in own.encode(pa.array(texts), np.array(closing, "<i4").tobytes()):
            ends = np.cumsum(sizes)
            for text, a, b in zip(texts[first:last], ends - sizes, ends):
                assert flat[a:b].tolist() == library.encode(text, add_special_tokens=False).ids + list(closing)
            at += last - first
        assert at == len(texts)


def test_token_file_layout(spark):
    """Dictionary ids, delta-encoded numbers (which only format 2 has), a page index."""
    import glob

    import pyarrow.parquet as pq

    folder = f"{shared_dir(spark)}/tokens"
    texts = [" ".join(some_words(random.Random(i), 40)) for i in range(3000)]
    token_files.write_tokens(table(spark, texts), folder, public_tokenizers.path("word_bpe_49k.json"), parts=1)
    meta = pq.ParquetFile(glob.glob(f"{folder}/data/part-*")[0]).metadata
    columns = {c.path_in_schema: c for c in (meta.row_group(0).column(i) for i in range(meta.num_columns))}
    ids = next(c for name, c in columns.items() if name.startswith("ids."))
    assert "RLE_DICTIONARY" in ids.encodings
    assert all("DELTA_BINARY_PACKED" in columns[c].encodings and "RLE_DICTIONARY" not in columns[c].encodings for c in ("doc_id", "offset"))
    assert all(c.has_offset_index and c.has_column_index for c in (ids, columns["doc_id"]))
    some = token_files.read_tokens(spark, folder, ("doc_id", "n_tokens")).where("doc_id between 100 and 102").collect()
    assert [r.doc_id for r in some] == [100, 101, 102]


def test_crc32_of_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, 2])], "doc_id long, ids array<int>").coalesce(1)
    assert {r.doc_id: r.ids_crc32 for r in token_files.with_crc32(df).collect()} == {1: None, 2: 0, 3: zlib.crc32(np.array([1, 2], "<u4").tobytes())}
    assert token_files.with_crc32(df.limit(0)).count() == 0


CLASHING = ("_text", "_doc", "_gone", "_row", "_null", "_key", "_label", "a.b", "Kept", "IDS", "Items", "Score", "notices2", "c0", "doc", "gone", "at", "size", "row", "none")


def test_columns_with_any_name_come_back(spark):
    """Names like helper columns, in other cases, with dots: each comes back, or is replaced by a result."""
    texts = [*ODD[:6], "Licensed under the Apache License, Version 2.0.", "one two three four five six seven eight nine ten"] * 2
    df = spark.createDataFrame([(i, t, *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(texts)], "id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    kernel = language_id.Kernel.fit(["der und die das", "the and of it"] * 3, ["de", "en"] * 3)
    runs = {
        ("lang_pred", "score"): lambda: language_id.predict_languages(df, kernel),
        ("n_lines", "n_dropped", "kept"): lambda: line_dedup.dedup_lines(df, key="id"),
        ("notices",): lambda: license_scan.scan_licenses(df),
        ("score",): lambda: quality.score_quality(df, quality.fit_quality(df, labels, key="id")),
        ("severity", "grade"): lambda: toxicity.score_severity(df, toxicity.fit_severity(df, labels, key="id")),
        ("n_words", "hit_words", "items"): lambda: decontaminate.find_passages(df, bench),
        ("ids",): lambda: byte_bpe.encode(df, *VOCABULARY),
        ("decoded",): lambda: byte_bpe.decode(byte_bpe.encode(df.drop("IDS"), *VOCABULARY), *VOCABULARY),
        ("ids_crc32",): lambda: token_files.with_crc32(df.drop("IDS").withColumn("ids", F.array(F.lit(1)))),
    }
    for results, run in runs.items():
        out = run()
        assert out.columns[-len(results):] == list(results)
        rows = sorted(out.collect(), key=lambda r: r.id)
        assert [r.id for r in rows] == list(range(len(texts)))
        stay = [c for c in CLASHING if c in out.columns]
        assert {c.lower() for c in CLASHING} - {c.lower() for c in stay} <= {*results, "ids"}
        assert all(r[c] == f"{c}{r.id}" for r in rows for c in stay if c not in results)


def test_language_kernel_against_one_without_landmarks():
    """On a small set, where every text is a landmark, the projection is the kernel itself."""
    rng = random.Random(3)
    pools = {"a": "der und die das nicht ein".split(), "b": "the and of to in is".split(), "c": "le la et les des un".split()}
    texts, labels = zip(*[(" ".join(rng.choices(pools[k], k=12)), k) for k in "abc" for _ in range(10)])
    model = language_id.Kernel.fit(list(texts), list(labels))
    others = [" ".join(rng.choices(pools[k], k=9)) for k in "abc" for _ in range(5)]
    names, scores = model.predict(others)
    sets = [set(language_id.grams(t).tolist()) for t in (*texts, *others)]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    n = len(texts)
    want = [max("abc", key=lambda c: kernel[n + i, :n] @ np.linalg.solve(kernel[:n, :n] + np.eye(n), np.array([1.0 if y == c else -1.0 for y in labels]))) for i in range(len(others))]
    assert names == want and all(0 < s <= 1 for s in scores)


def test_ordinal_fit_is_a_stationary_point():
    """Gradients by differences: no weight over 0, and no threshold, can be moved for the better."""
    rng = np.random.default_rng(4)
    sets = [np.unique(np.array([*rng.choice(30, 6), *([200] if rng.random() < 0.2 + 0.6 * (g > 0) else []), *([201] if rng.random() < 0.1 + 0.7 * (g > 1) else [])], np.uint64)) for g in (0, 1, 2) for _ in range(80)]
    grades = np.repeat([0, 1, 2], 80)
    model = toxicity.Ordinal.fit(sets, grades)
    assert model.words.tolist() == [200, 201] and (model.weights > 0).all() and np.all(np.diff(model.thresholds) > 0)

    def value(weights, thresholds):
        x = np.zeros(len(sets))
        for i, s in enumerate(sets):
            x[i] = weights[toxicity._positions(model.words, s)].sum()
        over = np.concatenate([np.ones((len(sets), 1)), toxicity._chance(x[:, None] - thresholds), np.zeros((len(sets), 1))], 1)
        own = over[np.arange(len(sets)), grades] - over[np.arange(len(sets)), grades + 1]
        return np.log(own).reshape(3, -1).mean(1).mean() - toxicity.PENALTY / 2 * (weights ** 2).sum()

    best, step = value(model.weights, model.thresholds), 1e-4
    for i in range(len(model.weights)):
        moved = [value(model.weights + sign * step * np.eye(len(model.weights))[i], model.thresholds) - best for sign in (1, -1)]
        assert moved[0] < 1e-6 and (model.weights[i] < step or moved[1] < 1e-6)
    for i in range(len(model.thresholds)):
        assert all(value(model.weights, model.thresholds + sign * step * np.eye(len(model.thresholds))[i]) - best < 1e-6 for sign in (1, -1))


def test_other_scans_drop_the_vocabulary():
    import pyarrow as pa

    from logweave.llm.arrays import text_groups

    own = byte_bpe.ranks(*VOCABULARY)
    assert byte_bpe.ranks(*VOCABULARY) is own
    assert list(text_groups(pa.array(["a"]))) and not byte_bpe._loaded
    assert byte_bpe.ranks(*VOCABULARY) is not own
