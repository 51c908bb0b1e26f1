"""Keyed state in runs: what a batch writes, replays, restarts, removals, documents."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.streaming import changes as C

KIND = "k int, v string, n int"


def size(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    make = lambda: C.StateTable(spark, ["k"], ["n"], str(tmp_path))
    make().merge(spark.range(60_000).select(F.col("id").cast("int").alias("k"), F.md5(F.col("id").cast("string")).alias("v"), F.lit(0).alias("n")), 0)
    whole = size(tmp_path)
    for n in range(1, 8):
        make().merge(spark.createDataFrame([(k, f"v{n}", n) for k in range(n, n + 5)], KIND), n)
        written = sum(size(p) for p in tmp_path.iterdir() if p.name.endswith(f"-{n}") or p.name.endswith(f"-{n - 1}") and not p.name.startswith("0-"))
        assert written < whole / 20
    assert len(make().live(make().runs())) < 7  # small runs are merged with each other
    rows = {r.k: r.v for r in make().read().where("k < 14").collect()}
    assert [rows[k] for k in range(1, 12)] == ["v1", "v2", "v3", "v4", "v5", "v6", "v7", "v7", "v7", "v7", "v7"] and rows[0].startswith("cfcd")
    assert make().read().count() == 60_000


def test_runs_stay_few_and_each_row_is_rewritten_seldom(spark, tmp_path):
    state, rewritten = C.StateTable(spark, ["k"], ["n"], str(tmp_path)), 0
    rows = 2000
    for n in range(16):
        before = set(state.runs())
        part = spark.range(n * rows, (n + 1) * rows).select(F.col("id").cast("int").alias("k"), F.md5(F.col("id").cast("string")).alias("v"), F.lit(n).alias("n"))
        state.merge(part, n)
        rewritten += sum((b - a + 1) * rows for a, b in set(state.runs()) - before)
        assert len(state.live(state.runs())) <= 6
    assert state.read().count() == 16 * rows and rewritten <= 16 * rows * 6


def test_state_equals_a_dictionary_with_replays_and_restarts(spark, tmp_path):
    draw, want, kind = random.Random(3), {}, "k int, v string, n int, op string"
    for batch in range(12):
        rows = [(draw.choice([None, *range(8)]), f"{batch}.{n}", n, draw.choice(["ADD", "ADD", "REMOVE"])) for n in range(draw.randrange(0, 7))]
        for k, v, _, op in rows:
            want.pop(k, None)
            if op == "ADD":
                want[k] = v
        for _ in range(1 + batch % 2):  # every other batch comes twice, each time to a new process
            if batch == 7:  # a run that was cut off
                (tmp_path / "7-7").mkdir(exist_ok=True)
            C.StateTable(spark, ["k"], ["n"], str(tmp_path)).merge(spark.createDataFrame(rows, kind), batch, F.col("op") == "REMOVE")
        assert {r.k: r.v for r in C.StateTable(spark, ["k"], ["n"], str(tmp_path)).read().collect()} == want
    with pytest.raises(ValueError):
        C.StateTable(spark, ["k"], ["n"], str(tmp_path)).merge(spark.createDataFrame([], kind), 3)


def test_a_reader_outlives_the_next_batch(spark, tmp_path):
    state = C.StateTable(spark, ["k"], ["n"], str(tmp_path))
    for n in range(3):
        state.merge(spark.createDataFrame([(n, "x", n)], KIND), n)
    held = state.read()
    state.merge(spark.createDataFrame([(9, "y", 9)], KIND), 3)
    assert sorted(r.k for r in held.collect()) == [0, 1, 2]


def test_documents_equal_those_of_the_whole(spark, tmp_path):
    draw, values, kind = random.Random(9), {}, "commit_num long, op_num long, key string, op string, field string, value string"
    for batch in range(8):
        rows = [(batch, n, draw.choice(["a", "b", "c", None]), draw.choice(["ADD", "REMOVE"]), draw.choice(["p", "q", None]), draw.choice(["x", "y", None])) for n in range(12)]
        for _, _, key, op, field, value in rows:
            (values.setdefault(key, set()).add if op == "ADD" else values.setdefault(key, set()).discard)((field, value))
        for _ in range(1 + (batch == 4)):
            C.Documents(spark, str(tmp_path)).add(spark.createDataFrame(rows, kind), batch)
        want = {}
        for key, held in values.items():
            for field, value in sorted(p for p in held if None not in p):
                want.setdefault(key, {}).setdefault(field, []).append(value)
        assert {r.key: dict(r.fields) for r in C.Documents(spark, str(tmp_path)).read().collect()} == want


def test_stream_documents_in_many_batches(spark, tmp_path):
    from quarry.registry import QUERIES, load

    load()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("event_id")
    rows = events.collect()
    for n in range(0, len(rows), 333):
        spark.createDataFrame(rows[n : n + 333], events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["stream_documents"](spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in QUERIES["stream_documents"](spark, "/root/testdata/sf0.001").collect()} and got
