"""Exact order statistics by selection, against sorted lists."""

import math
import random

import numpy as np
import pytest
from quarry.operators import search as S


@pytest.fixture(scope="module")
def values():
    draw = random.Random(6)
    groups = {
        "even": [draw.uniform(-5, 5) for _ in range(800)], "ties": [draw.choice([1.0, 2.0, 2.5]) for _ in range(700)], "same": [4.0] * 300, "one": [7.5], "two": [1.0, 2.0],
        "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-6, 12) for _ in range(500)], None: [draw.gauss(0, 1) for _ in range(400)], "none": [],
    }
    return groups


def frame(spark, groups):
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [(k, None) for k in groups] + [("even", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize(("bins", "few"), [(2048, 100_000), (64, 20)])
def test_every_rank(spark, values, monkeypatch, bins, few):
    monkeypatch.setattr(S, "BINS", bins)
    monkeypatch.setattr(S, "FEW_ROWS", few)
    rows, key = S._packed(frame(spark, values), ["k"])
    ranks = sorted({0, 1, 5, 150, 299, 399, 499, 650, 799, 800, -1})
    asked = spark.createDataFrame([(k, r) for k in values for r in ranks], "k string, rank long")
    asked, _ = S._packed(asked, ["k"])
    got = {(r["_k"]["k"], r["rank"]): r["value"] for r in S.at_ranks(rows, key, "v", asked.select("_k", "rank")).collect()}
    assert got == {(k, r): sorted(vs)[r] for k, vs in values.items() for r in ranks if 0 <= r < len(vs)}


def test_one_group_of_all_rows_in_small_bins(spark, values, monkeypatch):
    monkeypatch.setattr(S, "BINS", 64)
    monkeypatch.setattr(S, "FEW_ROWS", 20)
    rows = frame(spark, {"even": values["even"], "ties": values["ties"]}).where("not isnan(v)")
    every = sorted(values["even"] + values["ties"])
    found = S.quantiles(rows, [], "v", {"a": 0.05, "b": 0.5, "c": 1.0}).first()
    assert all(math.isclose(found[name], np.quantile(every, q)) for name, q in (("a", 0.05), ("b", 0.5), ("c", 1.0)))
    stats = S.score_statistics(rows, column="v").first()
    assert stats.n == len(every) and math.isclose(stats.median, np.median(every)) and stats.p95 == every[math.floor(0.95 * (len(every) - 1))]


def test_groups(spark, values):
    rows = frame(spark, values).where("v is null or not isnan(v)")
    found = {r.k: (r.low, r.high) for r in S.quantiles(rows, ["k"], "v", {"low": 0.05, "high": 0.95}).collect()}
    assert set(found) == set(values) and found["none"] == (None, None)
    for k, vs in values.items():
        assert not vs or np.allclose(found[k], np.quantile(vs, [0.05, 0.95]), rtol=1e-9)
    stats = {r.k: r for r in S.score_statistics(rows, ["k"], "v").collect()}
    assert set(stats) == set(values) - {"none"} and stats["one"].kind == "insufficient_data" and stats["two"].median == 1.5
    assert S.score_statistics(rows.limit(0), ["k"], "v").collect() == []
