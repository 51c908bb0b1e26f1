"""Exact vector search by products of matrices against the SQL and sorted lists, and what it gives to the shuffle."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry import registry
from quarry.operators import search as S

registry.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Copies, mirrored vectors, null and zero ones, and two texts to choose from."""
    draw = np.random.default_rng(8)
    rows = draw.normal(size=(450, 6)).astype(np.float32)
    rows[40:200] = rows[0]
    rows[200:230] = -rows[100]
    some = [(i, None if i in (7, 300) else [0.0] * 6 if i == 11 else row.tolist(), i % 5) for i, row in enumerate(rows)]
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(some, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{path}/embeddings.parquet")
    texts = [(i, "other" if i % 3 else "none") for i in range(210)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["related_vectors", "tsd_selection"])
def test_equals_sql(spark, folder, name):
    duck = duckdb.connect()
    for table in ("embeddings", "documents"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    plain = lambda r: repr(["nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(map(plain, registry.QUERIES[name](spark, folder).collect())) == sorted(map(plain, duck.execute(registry.ORACLE_SQL[name]).fetchall()))


def test_tasks_give_the_best_alone(spark):
    rows = np.random.default_rng(1).integers(-2, 3, size=(3000, 4)).astype(float)
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.where("vec_id < 300").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    found = S.nearest(vectors, asked, 4)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.doc_id, r.score))
    length = np.sqrt((rows * rows).sum(axis=1))
    with np.errstate(invalid="ignore"):
        cosines = np.round(rows[:300] @ rows.T / length[:300, None] / length, 6)
    for q, row in enumerate(cosines.tolist()):
        want = sorted((-math.inf if math.isnan(s) else -s, i) for i, s in enumerate(row))[:4]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert all(math.isnan(s) if w == -math.inf else s == -w for (_, s), (w, _) in zip(got[q], want))


def test_scores_round_half_away_from_zero():
    # the cosine of (1, 0) and (3, 4) is 0.6; lengths are chosen so that no digit is left to chance
    table = lambda rows: (np.array(rows), np.sqrt((np.array(rows) ** 2).sum(axis=1)), np.zeros(len(rows), bool))
    assert S._millionths(table([[1.0, 0.0]]), table([[3.0, 4.0], [-3.0, 4.0], [0.0, 2.0]])).tolist() == [[600000, -600000, 0]]
