"""Fuzzy name groups: the prefix join and the greedy rounds against plain loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarry.operators import entities as E


def slow_first_fit(edges):
    nodes, near = sorted({n for e in edges for n in e}), {}
    for a, b in edges:
        if a < b:
            near.setdefault(a, set()).add(b)
    head = {}
    for node in nodes:
        if node not in head:
            for other in near.get(node, ()):
                head.setdefault(other, node)
    return head


def test_first_fit_equals_the_sequential_pass(spark):
    draw = random.Random(5)
    chain = [(f"c{n:02}", f"c{n + 1:02}") for n in range(8)]
    hub = [("h", f"x{n:03}") for n in range(300)] + [(f"x{n:03}", f"x{n + 1:03}") for n in range(0, 298, 2)]
    tangle = [(f"{draw.randrange(60):02}", f"{draw.randrange(60):02}") for _ in range(140)]
    edges = [*chain, *hub, *tangle, ("b", "a"), ("s", "s")]
    found = E.first_fit(spark.createDataFrame([*edges, *edges[:9]], "a string, b string")).collect()
    want = slow_first_fit(edges)
    assert {r.node: r["head"] for r in found} == want and len(found) == len(want)
    assert E.first_fit(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.85])
def test_near_texts_misses_no_pair(spark, threshold):
    draw = random.Random(8)
    texts = {"", "a", "b", "ab", "ba", "abc", "abcd", "aaaa", "aaaaa", "aaaaaaaaaaaa", "é" * 9, "ab" * 20, "abcab" * 60, "abcab" * 59 + "cc"}
    for _ in range(45):
        base = "".join(draw.choice("abcde ") for _ in range(draw.randrange(1, 30)))
        at = draw.randrange(len(base))
        texts |= {base, base[:at] + base[at + 1 :], base[:at] + "xy" + base[at:], base[at:] + base[:at]}
    rows = [(k, t) for k in ("p", "q") for t in texts]
    want = {(k, a, b) for k, a in rows for j, b in rows if k == j and a != b and SequenceMatcher(None, a, b).ratio() >= threshold}
    found = E.near_texts(spark.createDataFrame(rows, "block string, norm string"), ["block"], threshold).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 100


def test_prefixes_leave_out_what_all_texts_share(spark):
    names = [(f"ministry {n * 7919 % 99991:05} {n * 104729 % 99991:05} {n * 1299709 % 99991:05}",) for n in range(300)]
    texts = spark.createDataFrame(names, "norm string")
    held = E._prefixes(texts.withColumn("block", F.lit("")), ["block"], 0.85)
    commonest = held.groupBy("piece").count().agg(F.max("count")).first()[0]
    assert commonest <= 150  # though the pieces of the first word are in all 300


def test_groups_with_countries_equal_the_sequential_pass(spark):
    draw = random.Random(21)
    names = []
    for _ in range(25):
        base = " ".join("".join(draw.choice("abcde") for _ in range(draw.randrange(3, 8))) for _ in range(3))
        forms = [base, base + "s", base.replace("a", "e", 1), base.upper(), f"The {base}"]
        names += [f + draw.choice(["", "", " (Japan)", " (Laos)", " (Peru)"]) for f in forms for _ in range(3)]
    split = lambda n: (n[: n.index("(")].strip(), n[n.index("(") + 1 : -1]) if "(" in n else (n, "")
    left, want = sorted(set(names)), {}
    while left:
        seed, kin = left[0], []
        base, country = split(seed)
        for other in left[1:]:
            b, c = split(other)
            if not (country and c and country != c) and E.name_similarity(base, b) >= 0.85:
                kin.append(other)
        left = [n for n in left[1:] if n not in kin]
        if kin:
            want[min([seed, *kin], key=lambda n: (len(split(n)[0]), n))] = {seed, *kin}
    found = {}
    for r in E.similar_names(spark.createDataFrame([*((n,) for n in names), (None,)], "name string")).collect():
        found.setdefault(r.canonical, set()).add(r.name)
    assert found == want and len(want) > 20
    assert E.similar_names(spark.createDataFrame([], "name string")).count() == 0
