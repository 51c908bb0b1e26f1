"""An inverted cell index over vectors with product-quantised codes.

build() fits cells and code books on a bounded sample, and stores every vector under
the cell of its nearest centre, with a code of one byte for each part of the vector.
search() ranks a query set against all rows: the scan reads only the cells that the
queries visit, and of those only ids and codes; distances come from tables of each
query's parts with the code words, and the best candidates are read again and ranked
by exact cosine. With visits=None every cell is visited and every row ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.search import cosine, nearest

#: Query vectors that are looked up at a time.
QUERY_BLOCK = 4096
#: Vectors that the cells and code books are fitted on, and rows of a cell aimed at.
FIT_ROWS, CELL_ROWS = 20_000, 512
#: Most cells: each is a folder, and the sample must give every one some vectors.
MOST_CELLS = FIT_ROWS // 8
#: Bytes of a code, and words of each code book.
PARTS, WORDS = 16, 256
#: Cells that a query visits, and candidates ranked exactly for each result asked for.
VISITS, CANDIDATES = 24, 12
_ROUNDS, _SEED = 12, 5


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; null, zero and non-finite ones become zero."""
    rows = np.where(np.isfinite(rows).all(axis=1, keepdims=True), rows, 0.0)
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _means(rows: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's k-means over at most FIT_ROWS rows; an empty mean stays where it was."""
    draw = np.random.default_rng(_SEED)
    found = rows[draw.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(_ROUNDS):
        near = _nearest(rows, found)
        sums, n = np.zeros_like(found), np.bincount(near, minlength=len(found))
        np.add.at(sums, near, rows)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def _nearest(rows: np.ndarray, means: np.ndarray) -> np.ndarray:
    return ((means * means).sum(axis=1) - 2 * rows @ means.T).argmin(axis=1)


def _parts(width: int, parts: int) -> list[slice]:
    edges = np.linspace(0, width, min(parts, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of the usual width; any other vector is a zero row."""
    fits = np.array(vectors.value_lengths().fill_null(0)) == width
    out = np.zeros((len(vectors), width))
    held = vectors.filter(pa.array(fits)).flatten().cast(pa.float64()).fill_null(float("nan"))
    out[fits] = np.asarray(held).reshape(-1, width)
    return _unit(out)


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS) -> None:
    """Write the index of vectors under path.

    The model is fitted on FIT_ROWS vectors, the smallest by a hash of the id; every row
    is stored. Null, empty, zero and non-finite vectors, and those whose width is not the
    usual one, are stored in the cell -1, which no search reads, as they have no cosine.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usual = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = usual["d"] if usual else 1
    total = usual["count"] if usual else 0
    sample = rows.where(F.size("vector") == width).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").toArrow()
    fitted = _matrix(sample.column(0).combine_chunks(), width)
    fitted = fitted[np.abs(fitted).sum(axis=1) > 0]
    if not len(fitted):
        fitted = np.eye(1, width)
    cells = int(max(1, min(MOST_CELLS, len(fitted) // 8, total // CELL_ROWS + 1)))
    centres = _unit(_means(fitted, cells))
    books = [_means(fitted[:, p], WORDS) for p in _parts(width, parts)]
    kind = rows.schema["id"].dataType.simpleString()
    model = [(width, centres.tolist(), [b.tolist() for b in books], kind)]
    spark.createDataFrame(model, "width int, centres array<array<double>>, books array<array<array<double>>>, kind string").write.parquet(f"{path}/model")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column(1), width)
            known = np.abs(unit).sum(axis=1) > 0
            cell = np.where(known, (unit @ centres.T).argmax(axis=1), -1)
            codes = np.stack([_nearest(unit[:, p], b) for p, b in zip(_parts(width, parts), books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(list(map(bytes, codes)), pa.binary())], ["id", "vector", "cell", "code"]
            )

    stored = rows.mapInArrow(code, f"id {kind}, vector array<double>, cell int, code binary")
    # a range sort splits a cell of very many vectors over several files
    stored.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(f"{path}/cells")


def _model(spark: SparkSession, path: str) -> tuple[int, np.ndarray, list[np.ndarray]]:
    found = spark.read.parquet(f"{path}/model").first()
    return found["width"], np.array(found["centres"]), [np.array(b) for b in found["books"]]


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, code, cell): the index, in folders by cell."""
    kind = spark.read.parquet(f"{path}/model").first()["kind"]
    return spark.read.schema(f"id {kind}, vector array<double>, code binary, cell int").parquet(f"{path}/cells")


def candidates(spark: SparkSession, path: str, queries: DataFrame, keep: int, visits: int = VISITS) -> DataFrame:
    """(q, id, cell, near): for each of at most QUERY_BLOCK queries (q, v) the `keep`
    rows of the cells it visits that are nearest by codes."""
    width, centres, books = _model(spark, path)
    held = queries.select("q", F.col("v").cast("array<double>").alias("v")).toArrow()
    names, asked = held.column(0), _matrix(held.column(1).combine_chunks(), width)
    known = np.flatnonzero(np.abs(asked).sum(axis=1) > 0)
    names, asked = names.take(pa.array(known)).combine_chunks(), asked[known]
    many = min(visits, len(centres))
    visited = np.argpartition(-(asked @ centres.T), many - 1, axis=1)[:, :many] if len(asked) else np.zeros((0, many), int)
    of_cell: dict[int, list[int]] = {}
    for at, cells in enumerate(visited.tolist()):
        for cell in cells:
            of_cell.setdefault(cell, []).append(at)
    shared = spark.sparkContext.broadcast((names, asked, of_cell))
    slices = _parts(width, len(books))
    kinds = {f.name: f.dataType.simpleString() for f in queries.select("q").schema.fields + stored(spark, path).select("id").schema.fields}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, of_cell = shared.value
        for batch in batches:
            cell_of = batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, len(books))
            rows, of, scores = [], [], []
            for cell in np.unique(cell_of).tolist():
                here, asks = np.flatnonzero(cell_of == cell), np.array(of_cell.get(cell, ()), dtype=np.int64)
                for some in np.array_split(asks, max(1, -(-asks.size // 256))):
                    if not some.size:
                        continue
                    score = np.zeros((some.size, here.size))
                    for k, p in enumerate(slices):
                        score += (asked[some][:, p] @ books[k].T)[:, codes[here, k]]
                    most = min(keep, here.size)
                    best = np.argpartition(-score, most - 1, axis=1)[:, :most]
                    rows.append(here[best].ravel())
                    of.append(np.repeat(some, most))
                    scores.append(np.take_along_axis(score, best, axis=1).ravel())
            if rows:
                rows, of = np.concatenate(rows), np.concatenate(of)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(of)), batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(np.concatenate(scores))],
                    ["q", "id", "cell", "near"],
                )

    cells = stored(spark, path).where(F.col("cell").isin(sorted(of_cell)) if of_cell else F.lit(False)).select("id", "code", "cell")
    found = cells.mapInArrow(near, f"q {kinds['q']}, id {kinds['id']}, cell int, near double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))
    return found.withColumn("_nth", nth).where(F.col("_nth") <= keep).drop("_nth")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, visits: int | None = VISITS, skip_self: bool = False) -> DataFrame:
    """(q, doc_id, score, rank): the k best rows of the index for each query (q, v), by
    cosine to six decimals, ties by id. skip_self leaves out the row whose id is q.

    visits bounds the cells read for a query; None compares all rows exactly. Queries
    without a cosine have no result. Any number of queries is taken, QUERY_BLOCK at a time.
    """
    if visits is None:
        width = _model(spark, path)[0]
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return nearest(stored(spark, path).where("cell >= 0"), queries.where((F.size("v") == width) & finite), k, "id", "vector", skip_self)
    blocks, parts = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block) if blocks > 1 else queries
        close = candidates(spark, path, some, (k + skip_self) * CANDIDATES, visits)
        rows = stored(spark, path).select("id", "cell", "vector")
        exact = close.join(rows, ["cell", "id"]).join(some.select("q", F.col("v").cast("array<double>").alias("v")), "q")
        one = exact.select("q", F.col("id").alias("doc_id"), F.round(cosine(F.col("vector"), F.col("v")), 6).alias("score"))
        parts = one if parts is None else parts.union(one)
    scored = parts.distinct()
    if skip_self:
        scored = scored.where(F.col("q") != F.col("doc_id"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k)
