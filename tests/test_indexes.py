"""The vector index and the postings index against brute force, and what they read."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry import registry
from quarry.operators import postings, vector_index

registry.load()


def plan_of(df):
    return df._jdf.queryExecution().toString()


def best(vectors, k, asked):
    """{q: ids of the k best others} by cosine."""
    ids, unit = list(vectors), np.array([np.array(v) / np.linalg.norm(v) for v in vectors.values()])
    scores = unit[[ids.index(q) for q in asked]] @ unit.T
    found = {}
    for q, row in zip(asked, scores):
        order = sorted((-round(float(s), 6), i) for s, i in zip(row, ids) if i != q)
        found[q] = [i for _, i in order[:k]]
    return found


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """12,000 vectors of 64 dimensions, half of them around 300 points, half spread evenly."""
    draw = np.random.default_rng(3)
    points = draw.normal(size=(300, 64))
    rows = np.concatenate([points[draw.integers(0, 300, 6000)] + 0.45 * draw.normal(size=(6000, 64)), draw.normal(size=(6000, 64))])
    vectors = {i: row.tolist() for i, row in enumerate(rows)}
    odd = [(-1, None), (-2, []), (-3, [0.0] * 64), (-4, [float("nan")] * 64), (-5, [1.0]), (None, rows[0].tolist())]
    frame = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>")
    path = str(tmp_path_factory.mktemp("vectors") / "index")
    vector_index.build(frame, path)
    return frame, vectors, path


def test_recall_at_ten(spark, spread):
    frame, vectors, path = spread
    asked = frame.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    want = best(vectors, 10, [i for i in vectors if i % 100 == 0])
    got = defaultdict(set)
    for r in vector_index.search(spark, path, asked, 10, skip_self=True).where("doc_id is not null").collect():
        got[r.q].add(r.doc_id)
    recall = sum(len(got[q] & set(ids)) for q, ids in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9, recall


def test_recall_of_the_registered_query(spark):
    folder = "/root/testdata/sf0.1"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    want = best(vectors, 10, [i for i in vectors if i % 100 == 0])
    got = defaultdict(set)
    for r in registry.QUERIES["vector_index_topk"](spark, folder).collect():
        got[r.q].add(r.doc_id)
    recall = sum(len(got[q] & set(ids)) for q, ids in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9, recall


def test_all_cells_are_exact(spark, spread):
    frame, vectors, path = spread
    asked = frame.where("vec_id in (0, 100, -1, -3)").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    found = defaultdict(list)
    for r in vector_index.search(spark, path, asked, 12, visits=None, skip_self=True).orderBy("q", "rank").collect():
        found[r.q].append(r.doc_id)
    want = best(vectors, 12, [0, 100])
    assert set(found) == {0, 100} and [i for i in found[100] if i is not None][:11] == want[100][:11]


def test_only_visited_cells_are_read(spark, spread):
    frame, _, path = spread
    every = spark.read.parquet(f"{path}/cells").select("cell").distinct().count()
    one = frame.where("vec_id = 7").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    found = vector_index.candidates(spark, path, one, 20, visits=3)
    plan = plan_of(found)
    assert "PartitionFilters: [" in plan and "cell#" in plan and "vector" not in plan.split("ReadSchema")[-1]
    assert found.select("cell").distinct().count() <= 3 < every and found.count() == 20


def test_every_row_is_stored_and_empty_tables(spark, spread, tmp_path):
    frame, _, path = spread
    assert vector_index.stored(spark, path).count() == frame.count()
    vector_index.build(frame.limit(0), str(tmp_path / "none"))
    asked = frame.where("vec_id = 1").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    assert vector_index.search(spark, str(tmp_path / "none"), asked, 5).count() == 0
    assert vector_index.search(spark, path, asked.limit(0), 5).count() == 0


def slow_bm25(docs, fields, terms, boosts, k):
    """docs: {id: {field: words}}"""
    total, out = len(docs), {}
    average = {f: sum(len(d[f]) for _, d in docs) / total for f in fields}
    df = {(t, f): sum(t in d[f] for _, d in docs) for t in terms for f in fields}
    for i, d in docs:
        best = 0.0
        for f in fields:
            tf, s = Counter(d[f]), 0.0
            for t in terms:
                if tf[t]:
                    s += math.log(1 + (total - df[t, f] + 0.5) / (df[t, f] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d[f]) / average[f]))
            best = max(best, s * boosts[f])
        if round(best, 6) > 0:
            out[i] = round(best, 6)
    order = sorted(out.items(), key=lambda x: (-x[1], x[0]))
    return order[:k] if k else order


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (1 + i) for i in range(300)]
    docs = [(i, {"title": draw.choices(vocabulary, weights, k=draw.randint(0, 4)), "content": draw.choices(vocabulary, weights, k=draw.randint(0, 120))}) for i in range(3000)]
    frame = spark.createDataFrame([(i, " ".join(d["title"]), " ".join(d["content"]) or None) for i, d in docs], "doc_id long, title string, content string")
    path = str(tmp_path_factory.mktemp("postings") / "index")
    postings.build(frame, "doc_id", {"title": F.col("title"), "content": F.col("content")}, path)
    return docs, path


BOOSTS = {"title": 3.0, "content": 2.0}


@pytest.mark.parametrize("terms", [["w0"], ["w0", "w1", "w250"], ["w299", "w120"], ["w3", "absent"], ["absent"], ["w5", "w5"]])
@pytest.mark.parametrize("k", [3, 40, None])
def test_search_is_exact(spark, library, terms, k):
    docs, path = library
    got = sorted(((r.doc_id, r.score) for r in postings.search(spark, path, terms, BOOSTS, k).collect()), key=lambda x: (-x[1], x[0]))
    want = slow_bm25(docs, ("title", "content"), list(dict.fromkeys(terms)), BOOSTS, k)
    assert [i for i, _ in got] == [i for i, _ in want] and all(math.isclose(a, b, abs_tol=2e-6) for (_, a), (_, b) in zip(got, want))


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    postings.build(spark.createDataFrame([], "doc_id string, t string"), "doc_id", {"t": F.col("t")}, path)
    assert postings.search(spark, path, ["a"], {"t": 1.0}, 5).collect() == []
    path = str(tmp_path / "odd")
    rows = [(None, "a b"), ("x", None), ("y", ""), ("z", "a " * 50_000), ("z", "ab ab")]
    postings.build(spark.createDataFrame(rows, "doc_id string, t string"), "doc_id", {"t": F.col("t")}, path, lambda c: F.split(c, " "))
    assert sorted((r.doc_id or "-" for r in postings.search(spark, path, ["a", "ab"], {"t": 1.0}, 5).collect())) == ["-", "z"]


def test_restricted(spark, library):
    docs, path = library
    few = spark.createDataFrame([(i,) for i in range(0, 3000, 7)], "doc_id long")
    got = [r.doc_id for r in postings.search(spark, path, ["w0", "w9"], BOOSTS, 10, few).collect()]
    want = [i for i, _ in slow_bm25(docs, ("title", "content"), ["w0", "w9"], BOOSTS, None) if i % 7 == 0][:10]
    assert got == want


def test_only_the_terms_of_a_query_are_read(spark, library):
    _, path = library
    plan = plan_of(postings.blocks_of(spark, path, ["w1", "w2"]).select("most"))
    scan = [line for line in plan.split("\n") if "FileScan parquet" in line][-1]
    assert "PartitionFilters: [" in scan and "bucket#" in scan and "In(term, [w1,w2])" in scan.replace("'", "") and "postings" not in scan.split("ReadSchema")[-1]


def test_few_slices_are_scored(spark, library, monkeypatch):
    """For a rare and a common word most slices are left out by their bounds."""
    _, path = library
    every = postings.blocks_of(spark, path, ["w40", "w0"]).select("slice").distinct().count()
    seen, real = [], postings.materialise

    def spy(df):
        out = real(df)
        seen.append(out)
        return out

    monkeypatch.setattr(postings, "materialise", spy)
    found = postings.search(spark, path, ["w40", "w0"], BOOSTS, 3)
    assert found.count() == 3
    bounds, _, best_ = seen
    least = best_.agg(F.min("score")).first()[0]
    assert bounds.where(F.col("bound") >= least).count() < every


def test_build_shuffles_texts_and_blocks_alone(spark, tmp_path, monkeypatch):
    """Words are counted where their slice is: no shuffle of words, one of finished blocks."""
    rows = [(i % 400, " ".join(f"w{(i * k) % 97}" for k in range(1, 60))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plans, sort = [], type(docs).sortWithinPartitions
    monkeypatch.setattr(type(docs), "sortWithinPartitions", lambda df, *order: plans.append(df._jdf.queryExecution().executedPlan().toString()) or sort(df, *order))
    postings.build(docs, "doc_id", {"title": F.substring("text", 1, 20), "content": F.col("text")}, str(tmp_path / "index"))
    (plan,) = plans
    assert plan.count("Exchange hashpartitioning(slice") == plan.count("Exchange hashpartitioning") == plan.count("Exchange rangepartitioning") == 1
    held = spark.read.parquet(str(tmp_path / "index" / "blocks"))
    got = {(r.term, r.field, r.doc_id, r.n): r.tf for r in held.select("term", "field", F.inline("postings")).collect()}
    want = Counter()
    for i, text in rows:
        for field, words in (("title", text[:20].split()), ("content", text.split())):
            words = [w for w in words if len(w) >= 2]
            want.update((w, field, i, len(words)) for w in words)
    assert got == want and held.where("df != size(postings)").count() == 0
