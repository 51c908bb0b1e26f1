"""Table maintenance as DataFrame algebra: upserts, deletions, latest states, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key; order is ascending. An aggregate, so a hot key
    combines before the shuffle instead of being sorted in one task."""
    fields = [c for c in rows.columns if c not in keys]
    chosen = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*")


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """target with changes laid over it; of several changes of a key the last wins."""
    staged = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(staged, keys, [F.col("_new"), *map(F.col, order)]).drop("_new").select(*target.columns)


def delete(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """rows with bundle: numbers from 1 of the runs of equal kind within each key."""
    within = Window.partitionBy(*keys).orderBy(*order)
    turn = F.coalesce((F.lag(kind).over(within) != F.col(kind)).cast("int"), F.lit(1))
    return rows.withColumn("_turn", turn).withColumn("bundle", F.sum("_turn").over(within)).drop("_turn")


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule; a rule on null counts as broken."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for name in rules for x in (F.lit(name), F.col(name))])).alias("rule", "n"))


def batches(rows: DataFrame, order: Sequence[str], size: int, within: Sequence[str]) -> DataFrame:
    """rows with batch: consecutive groups of size within each partition key."""
    nth = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return rows.withColumn("batch", F.floor((nth - 1) / size))
