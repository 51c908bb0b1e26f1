"""Merkle manifest of a dataset: a digest for every row, a tree over the rows of
each group, a tree over the groups, and a proof for every row.

Rows are numbered within their group by a range sort, and every `arity ** height`
consecutive ones form an aligned block, one row of a table. A block's root comes
from a treehash stack; the roots of a tree's blocks are the leaves of the next
level, until one block holds the rest. Going down again, each block is traversed
leaf by leaf: one stack a level prepares the next run of siblings while the present
one is in use, so a path costs a few hashes and the state is a few digests a level.
The path above the block, which its leaves share, is appended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import forget, in_order, materialise, part_of, prepare, stretches

ARITY = 3
#: Levels of a block: 729 rows, so that a group of any size is dealt out evenly.
BLOCK_HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """UTF-8 byte count, ``:`` and the value as text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields one after another."""
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def fold(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda below, run: F.sha2(F.concat(run["left"], below, run["right"]), 256))


def siblings(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), ""), 256)


def _hash(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class TreeHash:
    """Nodes of one height over consecutive leaves, fed one leaf at a time. Below
    that height two nodes a level wait for their run to fill."""

    def __init__(self, height: int, start: int = 0):
        self.nodes: list[str] = []
        self.next = start
        self._held: list[list[str]] = [[] for _ in range(height)]

    def step(self, leaves: Sequence[str]) -> None:
        """Take the next leaf, if there is one; after the last, close open runs."""
        if self.next >= len(leaves):
            return
        node = leaves[self.next]
        self.next += 1
        for held in self._held:
            held.append(node)
            if len(held) < ARITY:
                break
            node = _hash(held)
            held.clear()
        else:
            self.nodes.append(node)
        if self.next == len(leaves):
            self._close()

    def _close(self) -> None:
        for level, held in enumerate(self._held):
            if held:
                node = _hash(held)
                held.clear()
                (self._held[level + 1] if level + 1 < len(self._held) else self.nodes).append(node)


def height_of(nodes: int) -> int:
    """Levels above so many nodes of one tree."""
    height, reach = 0, 1
    while reach < nodes:
        height, reach = height + 1, reach * ARITY
    return height


def block_root(leaves: Sequence[str], height: int) -> str:
    stack = TreeHash(height)
    for _ in leaves:
        stack.step(leaves)
    return stack.nodes[0]


def paths(leaves: Sequence[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn, the digests left and right of it in its run on every
    level, from the leaves up to the given height."""
    spans = [ARITY ** (level + 1) for level in range(height)]
    first, coming = [], []
    for level, span in enumerate(spans):
        stack = TreeHash(level)
        for _ in range(min(span, len(leaves))):
            stack.step(leaves)
        first.append(stack.nodes)
        coming.append(TreeHash(level, span))
    runs = first
    for at in range(len(leaves)):
        path, own = [], at
        for run in runs:
            own, place = divmod(own, ARITY)
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        yield path
        for level, span in enumerate(spans):
            coming[level].step(leaves)
            if (at + 1) % span == 0:
                runs[level] = coming[level].nodes
                coming[level] = TreeHash(level, coming[level].next)


def _levels(nodes: int, block_height: int) -> int:
    return block_height if nodes > ARITY**block_height else height_of(nodes)


def _blocks(nodes: DataFrame, block_height: int, carry: Sequence[str]) -> DataFrame:
    """(tree, block, n, held): one row for each aligned block of the nodes (tree,
    idx, n, digest), n being the tree's number of nodes on this level."""
    block = F.floor(F.col("idx") / F.lit(ARITY**block_height)).alias("block")
    held = F.sort_array(F.collect_list(F.struct("idx", "digest", *carry))).alias("held")
    return materialise(nodes.groupBy("tree", block, "n").agg(held))


def _roots(blocks: DataFrame, block_height: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = batch.column(2).to_pylist(), batch.column(3)
            found = [block_root(digests[at].as_py(), _levels(n, block_height)) for at, n in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], ["tree", "block", "n", "digest"])

    shape = "tree bigint, block bigint, n bigint, digest string"
    return materialise(blocks.select("tree", "block", "n", F.col("held.digest").alias("digests")).mapInArrow(run, shape))


_PATH = "array<struct<left:string,right:string>>"


def _traverse(blocks: DataFrame, above: DataFrame, block_height: int, carry: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """One row for every node of the blocks: tree, idx, digest and carry, its path
    to the top, and the columns `shared` of above (tree, block, path, ...)."""
    held = F.struct(F.col("held.idx").alias("idx"), F.col("held.digest").alias("digest"), *[F.col(f"held.{c}").alias(c) for c in carry])
    rows = blocks.select("tree", "block", "n", held.alias("held")).join(above, ["tree", "block"])
    kinds = {f.name: f.dataType for f in blocks.schema["held"].dataType.elementType.fields} | {f.name: f.dataType for f in above.schema.fields}
    own, common = ["idx", "digest", *carry], ["tree", *shared]
    path = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                held = row.column(1).flatten()
                digests = held[1].flatten().to_pylist()
                top = row.column(2)[0].as_py()
                upper = [r["left"] for r in top], [r["right"] for r in top]
                left, right, offsets = [], [], [0]
                for found in paths(digests, _levels(row.column(0)[0].as_py(), block_height)):
                    left += [run[0] for run in found] + upper[0]
                    right += [run[1] for run in found] + upper[1]
                    offsets.append(len(left))
                flat = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
                whole = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat).cast(path)
                same = pa.array([0] * len(digests), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[h.flatten() for h in held], whole, *[row.column(3 + k).take(same) for k in range(len(common))]], [*own, "path", *common]
                )

    shape = ", ".join([*[f"`{c}` {kinds[c].simpleString()}" for c in own], f"path {_PATH}", *[f"`{c}` {kinds[c].simpleString()}" for c in common]])
    return rows.select("n", "held", "path", *common).mapInArrow(run, shape)


def _above(blocks: DataFrame, block_height: int) -> DataFrame:
    """(tree, block, path, top): the path from each block's root to its tree's root."""
    roots = _roots(blocks, block_height)
    if not (roots.agg(F.max("block")).first()[0] or 0):
        return roots.select("tree", "block", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    nodes = roots.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / F.lit(ARITY**block_height)).alias("n"), "digest")
    upper = _blocks(nodes, block_height, ())
    found = materialise(_traverse(upper, _above(upper, block_height), block_height, (), ("top",)))
    forget(roots)
    forget(upper)
    return found.select("tree", F.col("idx").alias("block"), "path", "top")


def prove(
    rows: DataFrame, group_col: str = "source", order: Sequence[str] = ("doc_id", "leaf"), carry: Sequence[str] = ("doc_id",),
    block_height: int = BLOCK_HEIGHT,
) -> DataFrame:
    """The tree over rows with a column leaf: carry, leaf, path, subroot and root.

    Per group the leaves ascend in `order`; while several nodes remain, every three
    consecutive ones (the last run may be shorter, even one) become the SHA-256 of
    their hex digests. What remains is the group's subroot, a lone leaf itself. The
    subroots, ordered by group (null first, by UTF-8 bytes), give the root in the
    same way. path holds, level by level from the leaf up to the root, the digests
    of the run to the left and to the right of the node, joined; both are empty
    where it is alone.

    A null group is a group like any other; nulls in `order` come first; rows that
    agree in all of `order` take neighbouring places, and if they have equal leaves
    it does not matter which. An empty table gives an empty result. A group of any
    size is dealt out in blocks of arity ** block_height leaves.
    """
    prepare(rows.sparkSession)
    names = list(dict.fromkeys(["leaf", *carry]))
    ascending = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    rows = rows.select(F.col(f"`{group_col}`").alias("_group"), *[F.col(f"`{c}`") for c in dict.fromkeys([*names, *order])])
    placed = in_order(rows, F.col("_group").asc_nulls_first(), *ascending)
    # a group's number is the place of its first leaf, which follows the groups' order
    runs = stretches(placed, ["_group"]).select(
        "part", F.col("_group").alias("_owner"), "first", "before", F.col("total").alias("n"), F.col("first_of_all").alias("tree")
    )
    same = (part_of("_at") == F.col("part")) & F.col("_group").eqNullSafe(F.col("_owner"))
    nodes = placed.join(runs, same).select(
        "tree", (F.col("before") + F.col("_at") - F.col("first")).alias("idx"), "n", F.col("leaf").alias("digest"),
        *[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)],
    )
    held = [f"_c{k}" for k in range(len(carry))]
    blocks = _blocks(nodes, block_height, held)
    above = materialise(_above(blocks, block_height))
    groups = in_order(above.where("block = 0").select("tree", F.col("top").alias("digest")), F.col("tree").asc())
    order_of = stretches(groups, []).select("part", "first", "before", F.col("total").alias("n"))
    tops = groups.join(order_of, part_of("_at") == F.col("part")).select(
        F.lit(0).cast("bigint").alias("tree"), (F.col("before") + F.col("_at") - F.col("first")).alias("idx"), "n", "digest", F.col("tree").alias("group")
    )
    top_blocks = _blocks(tops, block_height, ("group",))
    whole = materialise(_traverse(top_blocks, _above(top_blocks, block_height), block_height, ("group",), ("top",)))
    joined = above.join(whole.select(F.col("group").alias("tree"), F.col("path").alias("rest"), F.col("top").alias("root")), "tree").select(
        "tree", "block", F.concat("path", "rest").alias("path"), F.col("top").alias("subroot"), "root"
    )
    for done in (placed, groups, top_blocks):
        forget(done)
    found = _traverse(blocks, joined, block_height, held, ("subroot", "root"))
    return found.select(*[F.col(h).alias(c) for h, c in zip(held, carry)], F.col("digest").alias("leaf"), "path", "subroot", "root")


def tampered(doc_id: Column, text: Column) -> Column:
    """text without its line feeds where 2 divides the CRC-32 of the decimal doc_id
    (a null doc_id: unchanged)."""
    even = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(text, "\n", "")).otherwise(text)


def check_copies(docs: DataFrame, block_height: int = BLOCK_HEIGHT) -> DataFrame:
    """The manifest of docs, and what a copy of each document proves against it whose
    text has lost its line feeds as tampered() says: doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified.

    Nulls in any column are a ``-`` in the leaf; a null doc_id or source comes first
    and is never changed by the copy; empty and very long texts are hashed whole;
    ties in doc_id are ordered by the leaf, and repeated rows have one row each;
    other columns are ignored; an empty table gives an empty result.
    """
    columns = [F.col(c) for c in FIELDS]
    copy = leaf([*columns[:-1], tampered(F.col("doc_id"), F.col("text"))])
    changed = F.when(F.contains("text", F.lit("\n")), copy)
    leaves = materialise(docs.select("source", "doc_id", leaf(columns).alias("leaf"), F.coalesce(changed, leaf(columns)).alias("copied")))
    found = prove(leaves, "source", ("doc_id", "leaf"), ("doc_id", "copied"), block_height)
    return found.select(
        "doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.col("copied")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
