import random

import corpus_pipeline as P
import numpy as np
from helpers import collect, documents, messy_rows, words
from quarry.llm import shingle_dedup as S


def shingle_set(text, k=5):
    ws = (text or "").encode().lower().split()
    n = min(k, len(ws))
    return {tuple(ws[a : a + n]) for a in range(len(ws) - n + 1)} if ws else set()


def brute(rows, threshold=0.8):
    """Smallest id of each row's component, over all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or len(x & y) / len(x | y) >= threshold:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(i, least.get(find(a), i))
    return [(i, least[find(a)]) for a, (i, _) in enumerate(rows)]


def varied():
    """Families with 0 to 6 changed words; many pairs on either side of 0.8."""
    draw, rows = random.Random(5), []
    for family in range(30):
        base = words(draw.randrange(20, 200), 900 + family, 5000).split()
        for _ in range(8):
            text = list(base)
            for _ in range(draw.randrange(7)):
                text[draw.randrange(len(text))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    draw.shuffle(rows)
    return rows


def test_stage_finds_every_pair_of_jaccard_08(spark, tmp_path):
    rows = varied()
    want = brute(rows)
    alone = {i for i, c in want if i == c}
    assert 30 < len(alone) < 200
    found = P.near_dedup(spark, documents(spark, rows), str(tmp_path))
    assert {r.doc_id for r in found.collect()} == alone
    assert collect(S.near_duplicates(documents(spark, rows)), "doc_id", "component_id") == sorted(want, key=repr)


def test_large_groups_equal_brute_force(spark, monkeypatch):
    """Groups of many times the texts a task may hold: near copies, a chain, and families that only touch."""
    draw, rows = random.Random(8), varied()
    long = words(400, 77, 9000).split()
    rows += [(1000 + i, " ".join(long[i * 3 : i * 3 + 100])) for i in range(90)]
    base = words(120, 78, 9000).split()
    for i in range(120):
        text = list(base)
        for _ in range(draw.choice([1, 1, 2, 6])):
            text[draw.randrange(len(text))] = f"y{draw.randrange(10**6)}"
        rows.append((2000 + i, " ".join(text)))
    rows += [(3000 + i, r[1]) for i, r in enumerate(rows[::40])]
    want = sorted(brute(rows), key=repr)
    for most in (4, 30, 100_000):
        monkeypatch.setattr(S, "GROUP_TEXTS", most)
        assert collect(S.near_duplicates(documents(spark, rows)), "doc_id", "component_id") == want, most


def test_groups_equal_brute_force():
    rows = varied()
    label = S.similar_groups([S.shingles(t, 5) for _, t in rows], 0.8)
    assert len(set(label.tolist())) == len({c for _, c in brute(rows)})
    assert S.similar_groups([np.zeros(0, dtype=np.uint64)], 0.8).tolist() == [0]


def test_pairs_at_the_threshold_share_a_band():
    draw = np.random.default_rng(3)
    for _ in range(100):
        own = draw.integers(0, 1 << 63, 100, dtype=np.uint64)
        x, y = np.sort(own[:90]), np.sort(np.concatenate((own[10:90], own[90:])))
        assert set(S.buckets(x)) & set(S.buckets(y))


def test_messy_rows(spark):
    got = collect(S.near_duplicates(documents(spark)), "doc_id", "component_id")
    assert len(got) == len(messy_rows())
    assert {c for i, c in got if i in (1, 2, 3)} == {1} and {c for i, c in got if i in (4, 5)} == {4}
    assert {c for i, c in got if i in (8, 9, 10)} == {8}
    assert S.near_duplicates(documents(spark).limit(0)).count() == 0
