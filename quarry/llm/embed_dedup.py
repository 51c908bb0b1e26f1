"""Near-duplicate vectors: spherical k-means cells, blocked cosine products.

Cells have two levels, so that their number grows with the vectors and no list of
centres does as fast: the square root of the number of cells are k-means regions,
and every CELL_ROWS-th vector of a region is the centre of one of its cells. A
vector lives in the cell of the nearest centre in its nearest region, and visits
the next nearest cells of the next nearest regions. A cell's residents are
compared, in blocks, with all its residents and visitors, so a link is found if
one of both vectors visits the other's home. With visits=None a vector visits
every region and cell that could hold a vector within the wanted angle: a linked
vector of another cell is beyond the plane between both centres by no more than
that angle. That finds every link, at the price of many more products where
vectors are spread evenly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import connected_components, forget, materialise, prepare

#: Vectors the regions are fitted on at most, vectors of a cell aimed at, regions a
#: vector visits and cells in each, residents and visitors of a block of comparisons,
#: and vectors of a block that is dealt to cells.
FIT_ROWS, CELL_ROWS, VISITS, CELL_VISITS, BLOCK_ROWS, VISITOR_ROWS, DEAL_ROWS = 20_000, 500, 6, 4, 1024, 4096, 8192
_ROUNDS = 8


def spherical_kmeans(vectors: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k unit centres of unit vectors; k-means++ starts, fixed rounds."""
    random = np.random.default_rng(seed)
    centres = np.empty((k, vectors.shape[1]))
    centres[0] = vectors[random.integers(len(vectors))]
    far = 1 - vectors @ centres[0]
    for at in range(1, k):
        weight = np.clip(far, 0, None)
        total = weight.sum()
        pick = random.choice(len(vectors), p=weight / total) if total > 0 else random.integers(len(vectors))
        centres[at] = vectors[pick]
        far = np.minimum(far, 1 - vectors @ centres[at])
    for _ in range(_ROUNDS):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        size = np.linalg.norm(sums, axis=1)
        good = size > 1e-12
        centres[good] = sums[good] / size[good, None]
    return np.unique(centres, axis=0)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _unit(found: np.ndarray) -> np.ndarray:
    # a first division by the largest component keeps the squares finite
    found = found / np.abs(found).max(axis=1, keepdims=True)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def reach(unit: np.ndarray, centres: np.ndarray, threshold: float, visits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and a mask of the cells it lives in or visits."""
    dots = unit @ centres.T
    home = dots.argmax(axis=1)
    each = np.arange(len(unit))
    if visits is None:
        # distances from the homes at hand only, by inner products: rounding is under 1e-7
        homes, of = np.unique(home, return_inverse=True)
        squares = (centres * centres).sum(axis=1)
        gaps = np.sqrt(np.maximum(squares[homes][:, None] + squares - 2 * (centres[homes] @ centres.T), 0.0))
        sine = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9
        mask = (dots[each, home][:, None] - dots) <= (sine * gaps + 1e-7)[of]
    else:
        mask = np.zeros(dots.shape, dtype=bool)
        nearest = np.argpartition(-dots, min(visits, dots.shape[1]) - 1, axis=1)[:, :visits]
        mask[each[:, None], nearest] = True
    mask[each, home] = True
    return home, mask


def block_links(
    nodes: list[str], unit: np.ndarray, weight: np.ndarray, homes: np.ndarray, seen: np.ndarray, rows: np.ndarray,
    cols: np.ndarray, cell: int, threshold: float,
) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Links of residents (rows) with residents and visitors (cols) of a cell:
    the summed weight of each vector's links, and a spanning forest of them. homes
    numbers the vectors' home cells, and seen is the mask of those that each vector
    lives in or visits. A visitor counts a link here only if its own home does not
    show it the resident."""
    place = {name: at for at, name in enumerate(dict.fromkeys(nodes))}
    of = np.array([place[name] for name in nodes], dtype=np.int64)
    near = unit[rows] @ unit[cols].T >= threshold
    near &= of[rows][:, None] != of[cols][None, :]
    links = np.zeros(len(place), dtype=np.int64)
    np.add.at(links, of[rows], near @ weight[cols])
    unseen = near & ~seen[rows][:, homes[cols]] & (homes[cols] != cell)[None, :]
    np.add.at(links, of[cols], weight[rows] @ unseen)
    label, big = np.arange(len(place)), len(place)
    while near.any():
        before = label.copy()
        lows = np.where(near, label[of[cols]][None, :], big).min(axis=1)
        np.minimum.at(label, of[rows], lows)
        lows = np.where(near, label[of[rows]][:, None], big).min(axis=0)
        np.minimum.at(label, of[cols], lows)
        label = label[label]
        if (label == before).all():
            break
    names = list(place)
    return links, [(names[at], names[to]) for at, to in enumerate(label.tolist()) if at != to]


def _deal(classes: DataFrame, regions: np.ndarray, threshold: float, visits: int | None, cell_visits: int | None) -> DataFrame:
    """(node, vector, n, cells, home) from (node, vector, n): the cells that a vector
    lives in or visits, and that in which it lives."""
    sent = classes.sparkSession.sparkContext.broadcast(regions)
    kind = classes.schema["vector"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, mask = reach(_unit(_matrix(batch.column(1))), sent.value, threshold, visits)
                at, region = np.nonzero(mask)
                yield pa.RecordBatch.from_arrays(
                    batch.take(pa.array(at)).columns + [pa.array(region), pa.array(region == home[at])], ["node", "vector", "region", "living"]
                )

    near = materialise(classes.select("node", "vector").mapInArrow(place, f"node string, vector {kind}, region bigint, living boolean"))
    sizes = materialise(near.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / DEAL_ROWS).alias("blocks")))
    centres = near.where(F.col("living") & (F.pmod(F.xxhash64("node", F.lit(1)), F.lit(CELL_ROWS)) == 0))
    # one row per region: as many as the square root of the number of cells
    dealt = near.join(F.broadcast(sizes), "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = materialise(
        centres.select("node", "vector", "region").join(F.broadcast(sizes), "region").select(
            "region", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.xxhash64("node").alias("centre"), "vector"
        )
    )

    def cells(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = mine.combine_chunks()
        theirs = theirs.sort_by("centre").combine_chunks()
        if not mine.num_rows:
            return pa.table({"node": pa.array([], pa.string()), "cell": pa.array([], pa.int64()), "living": pa.array([], pa.bool_())})
        # a region without a centre is one cell, named by the region
        name = theirs.column("centre").to_numpy() if theirs.num_rows else np.array([key[0].as_py()], dtype=np.int64)
        living = mine.column("living").to_numpy()
        if theirs.num_rows:
            home, mask = reach(
                _unit(_matrix(mine.column("vector").combine_chunks())), _unit(_matrix(theirs.column("vector").combine_chunks())), threshold, cell_visits
            )
        else:
            home, mask = np.zeros(mine.num_rows, dtype=np.int64), np.ones((mine.num_rows, 1), dtype=bool)
        at, cell = np.nonzero(mask)
        return pa.table({"node": mine.column("node").take(pa.array(at)), "cell": pa.array(name[cell]), "living": pa.array(living[at] & (cell == home[at]))})

    met = (
        dealt.select("region", "block", "node", "vector", "living").groupBy("region", "block")
        .cogroup(spread.groupBy("region", "block")).applyInArrow(cells, "node string, cell bigint, living boolean")
    )
    of_node = materialise(met.groupBy("node").agg(F.collect_set("cell").alias("cells"), F.max(F.when(F.col("living"), F.col("cell"))).alias("home")))
    for old in (near, sizes, spread):
        forget(old)
    return materialise(classes.join(of_node, "node"))


def links(
    embeddings: DataFrame,
    threshold: float = 0.9,
    visits: int | None = VISITS,
    cell_visits: int | None = CELL_VISITS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of embeddings.

    n_links counts the other rows at a cosine of threshold (over 0, double
    precision) or more, component_id is the smallest vec_id reachable over links,
    itself included, and kept marks the row that stands for its component.

    Equal vectors form one class, compared once and counted with its size, so
    groups of copies never become pairs. Vectors that are null, empty, zero, hold
    null or non-finite components or have another than the most frequent
    dimension link with nothing. A very long vector is compared whole; a vector as
    near to two centres takes either. A null vec_id is carried along and names no
    component; repeated rows count as further vectors; an empty table gives an
    empty result; other columns are ignored.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    vector = F.col("vector")
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    if rows.schema["vector"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("vector", vector.cast("array<double>"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "vector", lambda x: x != 0
    )
    usual = rows.where(fine).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return rows.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    node = F.when(fine & (F.size(vector) == usual["d"]), F.md5(F.concat_ws(",", vector.cast("array<string>"))))
    named = rows.withColumn("node", node)
    classes = materialise(
        named.where("node is not null").groupBy("node")
        .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    )
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(FIT_ROWS).select("vector").collect()
    unit = _unit(np.array([r["vector"] for r in sample], dtype=np.float64))
    regions = spherical_kmeans(unit, max(1, min(len(unit), math.isqrt(total // CELL_ROWS))))
    members = _deal(classes.select("node", "vector", "n"), regions, threshold, visits, cell_visits)
    places = members.select("node", "home", F.explode("cells").alias("cell"))
    # a cell has few residents and many visitors, so both are cut into blocks of their
    # own; most cells have one of each and are not named
    sizes = materialise(
        places.groupBy("cell")
        .agg(F.ceil(F.count_if(F.col("home") == F.col("cell")) / BLOCK_ROWS).alias("few"), F.ceil(F.count(F.lit(1)) / VISITOR_ROWS).alias("many"))
        .where("few > 1 or many > 1")
    )
    few, many = (F.greatest(F.coalesce(c, F.lit(1).cast("bigint")), F.lit(1).cast("bigint")) for c in ("few", "many"))
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    seen_by = members.select(F.col("home").alias("cell"), "node", "vector", "n", "home", "cells").join(sizes, "cell", "left")
    rows_of = seen_by.select("cell", block(few).alias("a"), others(many).alias("b"), "node", "vector", "n", "home", "cells", F.lit(True).alias("living"))
    visiting = members.select(F.explode("cells").alias("cell"), "node", "vector", "n", "home").join(sizes, "cell", "left")
    none = F.array().cast("array<bigint>")
    cols_of = visiting.select("cell", others(few).alias("a"), block(many).alias("b"), "node", "vector", "n", "home", none.alias("cells"), F.lit(False).alias("living"))

    def compare(group: pa.Table) -> pa.Table:
        column = {name: group.column(name).combine_chunks() for name in group.column_names}
        nodes, living = column["node"].to_pylist(), column["living"].to_numpy(zero_copy_only=False)
        known, homes = np.unique(column["home"].to_numpy(), return_inverse=True)
        cell = int(np.searchsorted(known, column["cell"][0].as_py()))
        visited = column["cells"].flatten().to_numpy()
        place = np.minimum(np.searchsorted(known, visited), known.size - 1)
        here = known[place] == visited
        seen = np.zeros((len(nodes), known.size), dtype=bool)
        seen[np.repeat(np.arange(len(nodes)), column["cells"].value_lengths().to_numpy())[here], place[here]] = True
        found, forest = block_links(
            nodes, _unit(_matrix(column["vector"])), column["n"].to_numpy(), homes, seen,
            np.flatnonzero(living), np.flatnonzero(~living), cell, threshold,
        )
        names = list(dict.fromkeys(nodes))
        some = np.flatnonzero(found)
        return pa.table(
            {
                "node": pa.array([names[i] for i in some] + [u for u, _ in forest], pa.string()),
                "n": pa.array(found[some].tolist() + [0] * len(forest), pa.int64()),
                "other": pa.array([None] * len(some) + [v for _, v in forest], pa.string()),
            }
        )

    found = materialise(
        rows_of.unionByName(cols_of).groupBy("cell", "a", "b").applyInArrow(compare, "node string, n bigint, other string")
    )
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("linked"))
    roots = connected_components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    rooted = materialise(classes.select("node", "n", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    # written, so that the last join reads two plain shuffles and a vector of very many
    # copies can be split; rows without a node stay beside it
    info = materialise(rooted.join(least, "root").join(counts, "node", "left").select(
        "node", "component_id", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")
    ))
    ids = named.select("vec_id", "node")
    linked = ids.where("node is not null").join(info, "node").select("vec_id", "n_links", "component_id")
    alone = ids.where("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    for done in (found, rooted, least):
        forget(done)
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
