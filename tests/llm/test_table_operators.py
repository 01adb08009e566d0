"""Mixing, embeddings, the classifier and the pipeline."""

import glob
import os
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import bpe, components, embed, mixing, near, quality, shared, simhash
from fieldloom.llm.queries import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def shares(sizes, share=1.5, repeat=2, weights=(3, 1, 2)):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap = {s: repeat * sizes[s] for s in names}
    out, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), list(names)
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        over = [s for s in free if out[s] + left * w[s] / total >= cap[s]]
        if not over:
            for s in free:
                out[s] += left * w[s] / total
            break
        for s in over:
            left -= cap[s]
            out[s] = cap[s]
        free = [s for s in free if s not in over]
    return out


def test_mixing(spark, odd_docs, no_docs):
    many = spark.range(300).selectExpr("id + 100 AS doc_id", "repeat('w ', cast(id % 17 as int)) AS text", "concat('s', id % 5) AS source")
    df = odd_docs.select("doc_id", "text", "source").unionByName(many)
    got = mixing.per_document(df).collect()
    assert len(got) == df.count() and Counter(map(tuple, got)) == Counter(map(tuple, mixing.per_document(df.repartition(5)).collect()))
    sizes = Counter()
    for r in df.withColumn("n", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))).collect():
        sizes[r["source"]] += r["n"]
    goal = shares(sizes)
    taken, limit = Counter(), {}
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    for r in got:
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(goal[source[r["doc_id"]]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        if r["doc_id"] is not None and r["doc_id"] >= 100:
            taken[source[r["doc_id"]]] += r["taken"]
            limit[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - limit[s]) <= 40 for s in limit)
    copies = mixing.apply(odd_docs)
    per = Counter()
    for r in mixing.per_document(odd_docs).where("size > 0").collect():
        per[r["doc_id"]] += r["taken"] // r["size"]
    assert copies.columns == odd_docs.columns and Counter(r["doc_id"] for r in copies.collect()) == +per and sum(per.values()) > 0
    assert mixing.per_document(no_docs).count() == 0 and mixing.apply(no_docs).count() == 0


def test_every_source_is_within_half_a_document(spark):
    """Long documents at the cut, and on the given tables: no further document brings a source nearer to its target."""
    rng = np.random.default_rng(4)
    own = [(k, " ".join(["w"] * int(n)), f"s{k % 6}") for k, n in enumerate(rng.choice([3, 8, 20, 900], 400, p=[0.4, 0.3, 0.2, 0.1]))]
    for df in (spark.createDataFrame([*own, *own[:3]], "doc_id long, text string, source string"), spark.read.parquet(f"{SMALL}/documents.parquet")):
        rows = mixing.per_document(df).collect()
        source = {r["doc_id"]: r["source"] for r in df.collect()}
        got, goal, longest = Counter(), {}, Counter()
        for r in rows:
            s = source[r["doc_id"]]
            got[s] += r["taken"]
            goal[s] = r["target"]
            longest[s] = max(longest[s], r["size"])
        assert all(abs(got[s] - goal[s]) <= longest[s] / 2 + 1e-6 for s in goal), {s: (got[s], goal[s], longest[s]) for s in goal}
        assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.per_document(df.repartition(3)).collect()))


def test_one_source_takes_one_and_a_half_times(spark):
    df = spark.range(50).selectExpr("id AS doc_id", "'a b c d' AS text", "'s' AS source")
    assert sum(r["taken"] for r in mixing.per_document(df).collect()) == 300


def test_components(spark):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 90)]
    links += [(7000 + (k * 37) % 200, 7000 + ((k + 1) * 37) % 200) for k in range(190)]  # a long path in no order
    df = spark.createDataFrame([*links, (3, 3), (None, 4), (4, None)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in {y for a, b in links if a != b for y in (a, b)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng):
    centres = rng.normal(size=(60, 16))
    rows = [(k, (centres[k % 60] + rng.normal(scale=0.08, size=16)).tolist(), int(k % 3)) for k in range(500)]
    rows += [(600 + k, rows[0][1], 0) for k in range(40)]
    rows += [(700, None, 0), (701, [0.0] * 16, 0), (702, [float("nan")] + [1.0] * 15, 0), (703, rows[1][1], None), (704, [1.0] * 4, 0), (705, [float("inf")] * 16, 1), (None, rows[2][1], 2), (706, [1e-200 * x for x in rows[0][1]], 0), (600, rows[0][1], 0)]
    return rows


def test_embeddings(spark):
    rows = vectors(np.random.default_rng(11))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embed.near_duplicates(df).collect()
    assert len(got) == len(rows)
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v is not None and len(v) == 16 and np.isfinite(v).all() and np.any(v)]
    x = embed.unit([rows[k][1] for k in ok])
    near = (x @ x.T >= 0.93) & np.equal.outer([rows[k][2] for k in ok], [rows[k][2] for k in ok])
    want = Counter()
    for j, k in enumerate(ok):
        want[rows[k][0], int(near[j].sum()) - 1] += 1
    for k in set(range(len(rows))) - set(ok):
        want[rows[k][0], 0] += 1
    found = Counter((r["vec_id"], r["n_links"]) for r in got)
    total = sum(n * c for (_, n), c in want.items())
    assert sum(n * c for (_, n), c in found.items()) >= 0.97 * total
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    by = {r["vec_id"]: r["component_id"] for r in got}
    assert by[639] == by[0] == 0 and by[706] == 0 and by[702] == 702
    assert embed.near_duplicates(df.where("vec_id = -1")).count() == 0
    assert embed.near_duplicates(df.where("vec_id = 700")).first()["n_links"] == 0


def test_recall_where_no_pair_is_in_the_sample(spark, monkeypatch):
    """Few pairs just over the threshold among many vectors, codebooks from a small sample: visits are calibrated on the whole table."""
    monkeypatch.setattr(embed, "SAMPLE", 300)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ends, near = embed.made_up(x[:400], 0.935)
    rows = [(k, v, 1) for k, v in enumerate([*x.tolist(), *near[:: embed.MADE_UP].tolist()])]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    every = np.concatenate([x, near[:: embed.MADE_UP]])
    want = int((every @ every.T >= 0.93).sum()) - len(every)
    assert want >= 800 and sum(r["n_links"] for r in got) >= 0.9 * want


def test_no_pair_below_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v, 1) for k, v in enumerate(rng.normal(size=(200, 32)).tolist())]
    assert all(r["n_links"] == 0 for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())


def test_multi_sequence_is_in_order():
    rng = np.random.default_rng(4)
    a, b = rng.uniform(size=9), rng.uniform(size=7)
    sums = (a[:, None] + b[None, :]).ravel()
    assert embed.multi_sequence(a, b, 63) == np.argsort(sums, kind="stable").tolist()


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SMALL}/../sf0.01/labels.parquet")
    model, feats = quality.train(docs, labels)
    got = quality.score(feats, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_scores_are_those_of_a_plain_discriminant(spark):
    """Densities by inverses and determinants, from all labelled rows at once."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model, feats = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score(feats, model).collect()}
    x = {r["doc_id"]: np.array(quality.statistics(r["text"] or "")) for r in docs.collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in x and not got[r["doc_id"]]["held_out"]}
    own = [np.array([x[i] for i in y if y[i] == k]) for k in (0, 1)]
    covs = [np.cov(a.T, bias=True) for a in own]
    pooled = sum(len(a) * c for a, c in zip(own, covs)) / len(y)

    def density(v, k):
        c = 0.9 * covs[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * (np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        d = v - own[k].mean(0)
        return np.log(len(own[k]) / len(y)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * d @ np.linalg.inv(c) @ d

    for i, v in x.items():
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(density(v, 1) - density(v, 0), -500, 500))), abs=1e-6)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["score"] >= 0.5}


def test_quality_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([*((k, 1) for k in range(5, 13)), (None, 1), (4, None)], "doc_id long, quality int")
    model, feats = quality.train(odd_docs, labels)
    got = quality.score(feats, model).collect()
    assert len(got) == odd_docs.count() and all(r["score"] == 1 for r in got)
    model, feats = quality.train(odd_docs, labels.where("doc_id = -1"))
    assert {r["score"] for r in quality.score(feats, model).collect()} == {0.5}
    assert quality.keep(odd_docs, model).count() == odd_docs.count() and quality.keep(no_docs, model).count() == 0


def test_held_out_rows_teach_nothing(spark, odd_docs):
    import zlib

    out = [k for k in range(13) if zlib.crc32(str(k).encode()) % 3 == 1]
    labels = spark.createDataFrame([(k, k % 2) for k in out], "doc_id long, quality int")
    model, _ = quality.train(odd_docs, labels)
    assert model.only == 0.5


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts, counts = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        texts = spark.createDataFrame(stage(spark, texts, SMALL).collect(), docs.schema)
        assert texts.columns == docs.columns
        counts.append(texts.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    want = Counter(map(tuple, bpe.round_trip(texts, tokenizer_path()).collect()))
    got = corpus_pipeline.run(spark, SMALL)
    assert Counter(tuple(r[:4]) for r in got.collect()) == want and "ids" in got.columns


def word_sets(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def firsts_of_groups(rows):
    """Smallest doc_id of every group of near copies, by comparing all pairs."""
    sets, label, linked = [word_sets(t) for _, t in rows], list(range(len(rows))), []
    for j in range(len(rows)):
        for k in range(j):
            both = len(sets[j] & sets[k])
            if sets[j] == sets[k] or both >= 0.8 * len(sets[j] | sets[k]):
                linked.append((j, k))
                old, new = label[j], label[k]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(i, least.get(x, i))
    return sorted(least.values()), linked


def test_near_copies_by_words(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):  # from exact copies to similarity about 0.6
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(40, 400)))]
        for copy in range(4):
            own = list(words)
            for at in rng.choice(len(own), len(own) * (copy * (k % 4)) // 120, replace=False):
                own[at] = f"new{copy}x{at}"
            rows.append((10 * k + copy, " ".join(own)))
    rows += [(1000, ""), (1001, " "), (1002, "few words"), (1003, "Few  WORDS"), (1004, "few words more")]
    want, linked = firsts_of_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(linked) > 100 and sorted(r["doc_id"] for r in near.one_of_each(df).collect()) == want
    assert len(want) < simhash.near_duplicates(df).select("component_id").distinct().count()
    kept = near.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id IS NULL").count() == 2 and near.one_of_each(no_docs).count() == 0


def test_many_near_copies_are_one(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*words[: k % 290], f"own{k}", *words[k % 290 + 1 :]])) for k in range(600)]
    assert [r["doc_id"] for r in near.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_pipeline_takes_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
            assert docs.columns == odd_docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_pipeline_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_copy(spark, docs, SMALL).collect()]
    assert sorted(i for i, _ in kept) == firsts_of_groups([(r["doc_id"], r["text"]) for r in docs.collect()])[0]


def test_stages_leave_results_alone_and_no_large_tables(spark, tmp_path):
    """A stage called twice, and the next one after it: both results can still be read, and what stays in the shared folder is small."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = shared.shared_dir(spark).removeprefix("file:")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = set(os.listdir(folder))
        one = stage(spark, docs, SMALL)
        left = [f for name in set(os.listdir(folder)) - before for f in glob.glob(f"{folder}/{name}/*.parquet")]
        assert not any("text" in pq.read_schema(f).names for f in left)
        two = stage(spark, docs.where("doc_id < 100"), SMALL)
        assert one.count() >= two.count() > 0
        docs = spark.createDataFrame(one.collect(), docs.schema)


def test_large_groups_of_like_anchors(spark):
    """Carriers of one passage, each in a component of its own, among copies and near copies: as by comparing all pairs, whatever the blocks."""
    rng = np.random.default_rng(3)
    passage, rows = [f"p{k}" for k in range(60)], []
    for k in range(120):
        own = [f"u{x}" for x in rng.integers(0, 10**6, int(rng.integers(5, 60)))]
        rows.append((k, " ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :])))
    for k in range(120, 160):
        words = rows[int(rng.integers(0, 120))][1].split()
        words[int(rng.integers(0, len(words)))] = f"e{k}"
        rows.append((k, " ".join(words)))
    want, linked = firsts_of_groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(linked) >= 20
    for block in (1024, 7):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(near, "BLOCK", block)
            assert sorted(r["doc_id"] for r in near.one_of_each(df).collect()) == want


def test_small_labels_leave_the_large_ones_grid_alone(spark, monkeypatch):
    """A large label keeps its codewords and few visits beside very many small ones, and all planted links are found in both."""
    rng = np.random.default_rng(15)
    n, seen = 4000, []
    own = rng.normal(size=(n // 2, 16))
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    near = own + 0.05 * rng.normal(size=own.shape)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(np.concatenate([own, near]))]
    tiny = [(10_000 + k, rng.normal(size=16).tolist(), 100 + k // 2) for k in range(3000)]
    for k in range(0, 400, 2):
        tiny[k + 1] = (tiny[k + 1][0], tiny[k][1], tiny[k + 1][2])
        tiny[k + 1][1][0] += 1e-3
    real = embed.calibrated
    monkeypatch.setattr(embed, "calibrated", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {r["vec_id"]: r for r in embed.near_duplicates(spark.createDataFrame(rows + tiny, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(seen) == 1 and len(seen[0].first) == 16 and seen[0].visits < 64
    x = embed.unit([r[1] for r in rows])
    want = ((x @ x.T >= 0.93).sum(1) - 1).tolist()
    found = sum(got[k]["n_links"] for k in range(n))
    assert all(got[k]["n_links"] <= want[k] for k in range(n)) and found >= 0.98 * sum(want) > 1000
    assert all(got[10_000 + k]["n_links"] == 1 for k in range(400)) and len({got[10_000 + k]["component_id"] for k in range(400)}) == 200
    y = embed.unit([r[1] for r in tiny])
    assert all(got[10_000 + k]["n_links"] == int(y[k] @ y[k ^ 1] >= 0.93) for k in range(400, 3000))
