import random

import numpy as np
import pytest
from helpers import collect
from quarry.llm import embed_dedup as E
from test_simhash import components

KIND = "vec_id long, embedding array<float>, label int, node string, cell int, n int, root string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2, "r") for i, v in rows], KIND)


def brute(rows, threshold=0.9):
    fine = {k: np.array(v, dtype=np.float32).astype(float) for k, (i, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    unit = {k: v / np.linalg.norm(v) for k, v in fine.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= threshold]
    root = components(links, list(range(len(rows))))
    out = []
    for k, (i, v) in enumerate(rows):
        ids = [rows[j][0] for j in root if root[j] == root[k] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((i, sum(k in pair for pair in links), least, i == least))
    return sorted(out, key=repr)


def vectors(seed=1, groups=25, size=6):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = draw.normal(size=8)
        for _ in range(size):
            rows.append((len(rows), (centre + draw.normal(size=8) * 0.35).astype("f4").tolist()))
    rows += [(500 + k, rows[3][1]) for k in range(5)]
    return rows


@pytest.mark.parametrize("visits", [None, 8])
def test_equals_brute_force(spark, monkeypatch, visits):
    monkeypatch.setattr(E, "CELL_ROWS", 8)
    monkeypatch.setattr(E, "BLOCK_ROWS", 16)
    monkeypatch.setattr(E, "VISITOR_ROWS", 25)
    monkeypatch.setattr(E, "DEAL_ROWS", 30)
    rows = vectors()
    found = E.links(frame(spark, rows), visits=visits, cell_visits=visits)
    assert collect(found, "vec_id", "n_links", "component_id", "kept") == brute(rows)


@pytest.mark.parametrize("visits", [{"visits": 3, "cell_visits": 2}, {}])
def test_recall_of_spread_vectors(spark, monkeypatch, visits):
    """Evenly spread vectors with planted pairs at cosine 0.90 to 0.93; {}: as the registered query."""
    monkeypatch.setattr(E, "CELL_ROWS", 20)
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(1500)]
    for i in range(300):
        x = np.array(rows[i][1]) / np.linalg.norm(rows[i][1])
        w = draw.normal(size=8)
        w -= (w @ x) * x
        c = draw.uniform(0.9, 0.93)
        rows.append((2000 + i, (c * x + np.sqrt(1 - c * c) * w / np.linalg.norm(w)).tolist()))
    unit = np.array([r[1] for r in rows], dtype="f4").astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    all_links = int((unit @ unit.T >= 0.9).sum()) - len(rows)
    got = sum(r[1] for r in collect(E.links(frame(spark, rows), **visits), "vec_id", "n_links"))
    assert (0.97 if not visits else 0.9) * all_links <= got <= all_links


def test_messy_rows(spark):
    rows = vectors(3, 4, 3) + [
        (900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [float("inf")] + [1.0] * 7), (905, [None] + [1.0] * 7),
        (906, [1.0] * 7), (907, [1e30] * 8), (908, [1e-30] * 8), (909, [1.0] * 8),
    ]
    draw = random.Random(1)
    draw.shuffle(rows)
    got = {r[0]: r[1:] for r in collect(E.links(frame(spark, rows)), "vec_id", "n_links", "component_id", "kept")}
    for i in range(900, 907):
        assert got[i] == (0, i, True)
    assert got[907] == (2, 907, True) and got[908] == (2, 907, False) and got[909] == (2, 907, False)
    twice = rows + [rows[0], (None, rows[0][1])]
    assert E.links(frame(spark, twice)).count() == len(twice)


def test_nothing_to_compare(spark):
    assert E.links(frame(spark, [(1, None), (2, [0.0])])).count() == 2
    assert E.links(frame(spark, vectors()).limit(0)).count() == 0
