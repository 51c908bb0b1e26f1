"""Mixing: targets against a slow version, and what the mix must keep to."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from helpers import CLASH, messy_rows
from pyspark.sql import functions as F
from quarry.llm import mixing, queries

SPACE = " \t\n\x0b\x0c\r"


def n_words(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return len(text.split(" ")) - text.split(" ").count("")


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        rest, whole = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: Fraction(most * sizes[s]) if s in full else rest * weight[s] / whole for s in names}
        above = {s for s in names if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def docs_of(spark, rows):
    """rows: (doc_id, source, text)"""
    filled = [(i, t, "en", s, len(t) if t is not None else None, 1, 2, 3, 4, 5, 6, 7, "n", "v", 8, 9, 10, 11) for i, s, t in rows]
    return spark.createDataFrame(filled, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}, no long, row long, size long, target int")


def check(spark, rows, **options):
    docs = docs_of(spark, rows)
    got = mixing.taken(docs, **options).collect()
    sizes = defaultdict(int)
    for _, source, text in rows:
        sizes[source] += n_words(text)
    targets = slow_targets(sizes)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == Counter(
        (i, n_words(t), sizes[s], round(float(targets[s]), 6)) for i, s, t in rows
    )
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    return got, sizes, targets


def test_targets_and_amounts(spark):
    rows = [(i, f"s{i % 7}", " ".join(["w"] * (1 + i * i % 97))) for i in range(200)] + [(1000 + i, "hot", "a b c " * 40) for i in range(100)]
    got, sizes, targets = check(spark, rows)
    by_source = defaultdict(int)
    source_of = {i: s for i, s, _ in rows}
    for r in got:
        by_source[source_of[r.doc_id]] += r.taken
    for source, target in targets.items():
        block = -(-sizes[source] // min(sizes[source], mixing.LEAST_BLOCKS))
        drawn = float(target) / block  # blocks differ by a word, and so many are drawn
        assert abs(by_source[source] - target) <= block / 2 + 2 * math.sqrt(drawn)
    assert sorted(got) == sorted(mixing.taken(docs_of(spark, rows)).collect())


def test_messy_rows(spark):
    rows = [(i, ["a", None, "é", "𝒛", "￿"][k % 5], t) for k, (i, t) in enumerate(messy_rows())]
    rows += [(1, "none", None), (2, "none", ""), (3, "tiny", "one"), (3, "tiny", "one")]
    check(spark, rows)


def test_a_capped_source_is_taken_three_times(spark):
    got, _, _ = check(spark, [(1, "a", "x y"), (2, "b", "w " * 5000), (3, "c", "w " * 5000)])
    assert {r.doc_id: r.taken for r in got}[1] == 6


def test_no_rows_and_no_words(spark):
    assert mixing.taken(docs_of(spark, []).limit(0)).collect() == []
    got, _, _ = check(spark, [(1, "a", None), (2, None, " ")])
    assert [r.taken for r in got] == [0, 0]


def test_shards(spark):
    """Every shard has its size, a pass takes no word twice, and sums agree with taken()."""
    rows = [(i, f"s{i % 4}", " ".join(["w"] * (3 + i % 11))) for i in range(160)]
    options = {"block_words": 16, "least_blocks": 8, "shard_blocks": 5}
    found = mixing.mix(docs_of(spark, rows), **options).collect()
    blocks, words, sums = defaultdict(set), Counter(), Counter()
    for r in found:
        blocks[r.shard].add((r.source, r.epoch, r.block))
        words.update((r.doc_id, r.epoch, w) for w in range(r.start, r.start + r.words))
        sums[r.doc_id] += r.words
    assert set(map(len, blocks.values())) <= {4, 5} and max(blocks) + 1 == len(blocks)
    assert set(words.values()) == {1}
    assert sorted(r.place for r in found if r.shard == 1) == list(range(1, 1 + sum(r.shard == 1 for r in found)))
    got, _, _ = check(spark, rows, **options)
    assert {r.doc_id: r.taken for r in got} == {i: sums[i] for i, _, _ in rows}


def test_hypergeometric_draws(spark):
    """Inversion against the exact distribution, extremes included."""
    cases = [(7, 20, 9), (0, 5, 3), (5, 5, 3), (3, 10, 0), (3, 10, 10), (400, 1000, 500), (1, 1_000_000, 500_000)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k long, good long, total long, draws long")
    many = frame.crossJoin(spark.range(2000)).select("k", mixing.hypergeometric(F.col("good"), F.col("total"), F.col("draws"), mixing.uniform("k", "id")).alias("x"))
    seen = defaultdict(Counter)
    for r in many.groupBy("k", "x").count().collect():
        seen[r.k][r.x] += r["count"]
    for k, (good, total, draws) in enumerate(cases):
        exact = {x: Fraction(math.comb(good, x) * math.comb(total - good, draws - x), math.comb(total, draws)) for x in range(max(0, draws - total + good), min(good, draws) + 1)} if total < 10_000 else {0: Fraction(1, 2), 1: Fraction(1, 2)}
        assert set(seen[k]) <= set(exact)
        mean = sum(x * p for x, p in exact.items())
        spread = math.sqrt(float(sum(x * x * p for x, p in exact.items()) - mean**2))
        assert abs(sum(x * n for x, n in seen[k].items()) / 2000 - float(mean)) <= 5 * spread / math.sqrt(2000) + 1e-9


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += n_words(t)
    targets, want = slow_targets(sizes), {i: s for i, s, _ in rows}
    for r in queries.op11_mixing(spark, folder).collect():
        assert math.isclose(r.target, targets[want[r.doc_id]], rel_tol=1e-12) and r.taken <= 3 * r["size"]
