"""What grows with the input in queries of spans and pairs, on plans and small tables."""

import random
import re

from pyspark.sql import functions as F
from quarry import registry
from quarry.operators import spans as P
from quarry.plans import relational

registry.load()
SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_pairs_are_counted_in_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(relational, "PAIR_ROWS", 500)
    few = registry.QUERIES["shared_value_pairs"](spark, SF)
    n = few.select(F.sum("shared")).first()[0]
    assert few.rdd.getNumPartitions() >= n / 500 > 4
    monkeypatch.setattr(relational, "PAIR_ROWS", 10**9)
    one = registry.QUERIES["shared_value_pairs"](spark, SF)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect()))


def test_structured_chunks_shuffle_nothing(spark):
    plan = plan_of(registry.QUERIES["structured_chunks"](spark, SF))
    assert "Exchange" not in plan and "FlatMapGroups" not in plan


def test_highlights_take_what_the_pattern_takes(spark):
    draw = random.Random(4)
    tokens = ["the", "und", "The", "a", "\n", "-", "thermal", "ccc " * 9, " " * 30, "x" * 74, "y" * 75, "z" * 76, "_the", "\U0001f600"]
    texts = ["".join(draw.choice(tokens) + draw.choice(["", " "]) for _ in range(draw.randint(0, 50))) for _ in range(300)] + ["", "the", "the the und"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", P.highlighted(F.col("text"), ["the", "und"]).alias("f"))
    assert ".{0,75}" not in plan_of(frame)  # which tries every start of a text
    want = [[re.sub(r"(?i)\b(the|und)\b", r"<mark>\1</mark>", x) for x in re.findall(r"(?is).{0,75}\b(?:the|und)\b.{0,75}", t)[:3]] for t in texts]
    assert [r.f for r in frame.orderBy("i").collect()] == want
