"""The Merkle manifest against a slow version that holds every tree whole."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from helpers import documents, messy_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quarry.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    return levels


def runs(levels, at):
    for nodes in levels[:-1]:
        run, place = nodes[at // 3 * 3 : at // 3 * 3 + 3], at % 3
        yield "".join(run[:place]), "".join(run[place + 1 :])
        at //= 3


def slow(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, digest(encoded(row)), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda t: t[:3])
        trees[name] = tree([t[2] for t in groups[name]])
    top = tree([trees[name][-1][0] for name in names])
    for k, name in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(groups[name]):
            path = [*runs(trees[name], at), *runs(top, k)]
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = digest(encoded((*row[:4], text)))
            for left, right in path:
                folded = digest(left + folded + right)
            root = top[-1][0]
            yield row[0], leaf, trees[name][-1][0], root, digest("".join(a + b for a, b in path)), folded, folded == root


def compare(spark, rows, block_height):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, block long")
    got = sorted(map(tuple, merkle.check_copies(docs, block_height).collect()), key=repr)
    assert got == sorted(slow(rows), key=repr)


@given(st.integers(1, 90), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_traversal_of_a_block(n, more):
    leaves, height = [digest(str(i)) for i in range(n)], merkle.height_of(n)
    levels = tree(leaves)
    assert len(levels) == height + 1 and merkle.block_root(leaves, height) == levels[-1][0]
    assert list(merkle.paths(leaves, height)) == [list(runs(levels, at)) for at in range(n)]
    root = levels[-1][0]
    for _ in range(more):  # levels above a lone node hash it alone
        root = digest(root)
    assert merkle.block_root(leaves, height + more) == root
    assert all(found[height:] == [("", "")] * more for found in merkle.paths(leaves, height + more))


@pytest.mark.parametrize("block_height", [1, 6])
def test_messy_rows(spark, block_height):
    rows = [(i, "s", "en", None if t is None else len(t), t) for i, t in messy_rows()]
    rows += [(i, None, None, None, f"line\n{i}\n") for i in range(20)] + [(-5, "é", "en", 1, "a\nb"), (-5, "é", "en", 1, "a\nb"), (None, "é", None, None, "\n")]
    rows += [(i, "", "de", i, None) for i in range(3)] + [(1, "𝒛", None, None, ""), (1, "￿", None, None, "")]
    compare(spark, rows, block_height)


def test_one_hot_group_in_small_blocks(spark):
    rows = [(i * 7 % 1000, "hot" if i % 3 else f"s{i % 13}", "en", i, f"text\n{i}") for i in range(300)]
    compare(spark, rows, 2)


def test_one_row_and_empty(spark):
    compare(spark, [(3, "only", "en", 4, "a\nb")], 6)
    assert merkle.check_copies(documents(spark, []).limit(0)).collect() == []


def test_any_changed_field_is_found(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(40)])
    found = merkle.prove(docs.withColumn("leaf", merkle.leaf([F.col(c) for c in merkle.FIELDS])), carry=("doc_id", "lang", "source", "n_chars", "text"))
    for name, other in (("doc_id", F.col("doc_id") + 1), ("lang", F.lit(None).cast("string")), ("n_chars", F.col("n_chars") + 1), ("text", F.concat("text", F.lit(" ")))):
        copy = merkle.leaf([other if c == name else F.col(c) for c in merkle.FIELDS])
        assert found.where(merkle.fold(F.col("path"), copy) == F.col("root")).count() == 0
    same = merkle.leaf([F.col(c) for c in merkle.FIELDS])
    assert found.where(merkle.fold(F.col("path"), same) == F.col("root")).count() == 40
