import hashlib
import random

import pytest
from helpers import collect, documents, messy_rows, words
from quarry.llm import substring_dedup as S


def brute(rows, length):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        if i is not None:
            for k in range(len(ws) - length + 1):
                w = tuple(ws[k : k + length])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - length + 1 if i is not None else 0):
            if first[tuple(ws[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    found = S.deduplicate(documents(spark, rows), **options)
    got = collect(found, "doc_id", "n_words", "n_removed", "kept_text")
    for r in found.collect():
        assert sum(s.hi - s.lo for s in r.spans) == r.n_removed
    return sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in got), key=repr)


def cases():
    draw = random.Random(3)
    passages = [words(draw.randint(40, 140), 900 + k, 5000) for k in range(6)]
    rows = []
    for i in range(70):
        parts = [words(draw.randint(0, 60), i * 10 + k, 5000) for k in range(3)]
        inside = draw.sample(passages, 2)
        if draw.random() < 0.3:  # a near copy of a passage
            ws = inside[0].split()
            ws[draw.randrange(len(ws))] = "changed"
            inside[0] = " ".join(ws)
        rows.append((i, " ".join([parts[0], inside[0], parts[1], inside[1], parts[2]])))
    rows += [(200, " ".join(["la"] * 400)), (201, " ".join(["la"] * 130)), (202, "x " + " ".join(["la"] * 60) + " y")]
    return rows


@pytest.mark.parametrize("shard_texts", [1, 5, 2048])
def test_equals_brute_force(spark, shard_texts):
    rows = cases()
    assert run(spark, rows, shard_texts=shard_texts) == brute(rows, 50)


def test_other_lengths(spark):
    rows = cases()
    for length, gram in ((3, 8), (20, 4)):
        assert run(spark, rows[:30], length=length, gram=gram) == brute(rows[:30], length)


def test_messy_rows(spark):
    assert run(spark, messy_rows()) == brute(messy_rows(), 50)
    assert S.deduplicate(documents(spark, []).limit(0)).count() == 0


def test_one_id_with_two_texts(spark):
    shared = words(90, 5)
    rows = [(1, shared), (2, f"{words(60, 6)} {shared}"), (2, words(100, 7)), (2, None)]
    assert run(spark, rows) == brute(rows, 50)


def test_carried_columns_keep_their_names(spark):
    found = S.deduplicate(documents(spark), carry=("doc_id", "text_key", "rank"))
    assert found.columns[:3] == ["doc_id", "text_key", "rank"] and {r.text_key for r in found.collect()} == {5}
