"""Closures, graph requests, compatible joins, and state that outlives its process."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from quarry.operators import graph as G
from quarry.streaming import changes as C

TRIPLE = "s string, p string, o string, o_kind string, g string"


def slow_closure(edges):
    onward = {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    out = set()
    for start in onward:
        seen, queue = {}, deque([(start, 0)])
        while queue:
            node, depth = queue.popleft()
            for up in onward.get(node, ()):
                if up not in seen:
                    seen[up] = depth + 1
                    queue.append((up, depth + 1))
        out |= {(start, up, depth) for up, depth in seen.items()}
    return out


def test_closure_equals_brute_force(spark):
    draw = random.Random(3)
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1000)]
    diamonds = [e for i in range(30) for e in ((f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}"))]
    cases = [
        [("x", "y"), ("y", "x")], [("a", "a")], [("a", "b")], chain, diamonds,
        [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(90)] + [("n1", "n2")] * 3,
    ]
    for edges in cases:
        found = G.closure(spark, spark.createDataFrame([*edges, (None, "z"), ("z", None)], "child string, parent string"))
        assert {tuple(r) for r in found.collect()} == slow_closure(edges)
        assert found.count() == len(slow_closure(edges))
    assert G.closure(spark, spark.createDataFrame([], "child string, parent string")).count() == 0


def test_compatible_join_equals_brute_force(spark):
    draw = random.Random(4)
    pick = lambda: draw.choice([None, "u", "v", "w"])
    left, right = [(pick(), pick(), i) for i in range(25)], [(pick(), pick(), i) for i in range(25)]
    a = spark.createDataFrame(left, "x string, y string, i int")
    b = spark.createDataFrame(right, "y string, x string, j int")
    fits = lambda p, q: p is None or q is None or p == q
    want = [(x or p, y or q, i, j) for x, y, i in left for q, p, j in right if fits(x, p) and fits(y, q)]
    found = G.compatible_join(a, b)
    assert sorted(map(tuple, found.select("x", "y", "i", "j").collect()), key=repr) == sorted(want, key=repr)
    assert "CartesianProduct" not in a.where("x is not null")._jdf.queryExecution().toString()
    assert G.compatible_join(a.select("i"), b.select("j")).count() == 625


def test_graph_requests(spark):
    data = spark.createDataFrame([("a", "p", "b", "iri", "g"), ("b", "q", "c", "literal", "g"), ("a", "p", "b", "iri", "h"), ("z", "p", "y", "iri", "g")], TRIPLE)
    lines = spark.createDataFrame([('<n> <p> "1" .',), ("<n> <p> <m> <k> .",), ("no statement",)], "value string")
    got = G.load(data, lines, "g")
    assert got.count() == 6 and {(r.s, r.g) for r in got.where("s = 'n'").collect()} == {("n", "g"), ("n", "k")}
    graphs = spark.createDataFrame([("g",), ("h",)], "g string")
    assert {r.g for r in G.create(graphs, "new").collect()} == {"g", "h", "new"} and G.create(graphs, "g", silent=True).count() == 2
    with pytest.raises(ValueError):
        G.create(graphs, "g")
    left, known = G.drop(data, graphs, "h")
    assert left.count() == 3 and [r.g for r in known.collect()] == ["g"]
    with pytest.raises(ValueError):
        G.drop(data, graphs, "none")
    assert G.drop(data, graphs, "none", silent=True)[0].count() == 4
    kept = G.delete_where(data, [("?s", "p", "?m"), ("?m", "q", "?o")], graph="g")
    assert sorted((r.s, r.g) for r in kept.collect()) == [("a", "h"), ("z", "g")]


def test_state_survives_a_new_process(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, "k int, v string, n int")

    def rows(state):
        return sorted((r.k, r.v) for r in state.read().collect())

    make = lambda: C.StateTable(spark, ["k"], ["n"], str(tmp_path))
    make().merge(batch((1, "a", 0), (2, "b", 0)), 0)
    make().merge(batch((3, "c", 1)), 1)
    assert rows(make()) == [(1, "a"), (2, "b"), (3, "c")]
    again = make()
    again.merge(batch((3, "c", 1)), 1)  # a batch repeated after a failure
    assert rows(again) == [(1, "a"), (2, "b"), (3, "c")]
    (tmp_path / "2").mkdir()  # a version that was cut off
    (tmp_path / "2" / "part-0.parquet").write_text("broken")
    assert rows(make()) == [(1, "a"), (2, "b"), (3, "c")]
    for n in range(2, 9):
        make().merge(batch((1, f"v{n}", n)), n)
    assert rows(make()) == [(1, "v8"), (2, "b"), (3, "c")] and len(make().committed()) == 3


@pytest.mark.parametrize("optimised", [False, True])
def test_bundles_over_batches_equal_those_of_the_whole(spark, tmp_path, optimised):
    draw = random.Random(7)
    records = [(n // 9, n % 9, draw.choice("xyz"), draw.choice(["ADD", "REMOVE"])) for n in range(200)]
    kind = "commit_num long, op_num long, key string, op string"
    want = {tuple(r) for r in C.bundled(spark.createDataFrame(records, kind), optimised).collect()}
    at, n = 0, 0
    while at < len(records):
        size = draw.randint(1, 30)
        part = spark.createDataFrame(records[at : at + size], kind)
        for _ in range(1 + (n == 2)):  # the third batch comes twice
            C.Bundles(spark, optimised, str(tmp_path)).add(part, n)
        at, n = at + size, n + 1
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/bundles").drop("batch").collect()} == want and n > 8


def test_drain_retries_and_poll(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    tries, seen = [], []

    def each(batch, batch_id):
        tries.append(batch_id)
        if len(tries) == 1:
            raise RuntimeError("once")
        seen.extend(r.id for r in batch.collect())

    C.drain(stream, each, f"{tmp_path}/ck", retries=2, wait=0.01)
    assert sorted(seen) == list(range(10)) and len(tries) == 2
    assert C.poll(stream, each, f"{tmp_path}/ck", budget=4, wait=0.5) == 0
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
    assert C.poll(stream, each, f"{tmp_path}/ck", budget=1, wait=0.5) == 1 and sorted(seen) == list(range(12))


def test_stream_of_many_files_equals_the_batch(spark, tmp_path):
    from quarry.registry import QUERIES, load

    load()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id")
    rows = events.collect()
    for n in range(0, len(rows), 333):  # one file each, older first, commits of 100 cut
        spark.createDataFrame(rows[n : n + 333], events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["stream_bundles"](spark, str(tmp_path)).collect()}
    records = events.select(F.floor(F.col("event_id") / 100).alias("commit_num"), F.col("event_id").alias("op_num"), F.col("user_id").alias("key"), F.col("event_type").alias("op"))
    want = C.bundled(records).groupBy("commit_num", "key").agg(F.max("bundle"), F.count(F.lit(1)))
    assert got == {tuple(r) for r in want.collect()}
