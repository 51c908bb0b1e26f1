"""Mixing sources to target weights.

Each source's documents stand in a hashed order, and its words are cut into blocks of
equal size. A source owes the mix a whole number of blocks, its quota; a quota beyond
one pass takes further passes, each in a permutation of its own. The quotas of all
sources are split among the output shards by a tree: a node's blocks are dealt to its
two halves by multivariate hypergeometric draws, as a shuffle of all blocks would, so
every shard has its exact size and every source its exact quota. The numbers of blocks
of the shards before it tell each shard which blocks of a source's permutation are its
own, and a shard is shuffled by itself.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._shared import forget, in_order, materialise, part_of, stretches

#: Words of a block, and the fewest blocks a source is cut into, if it has so many
#: words: a source's quota is off its target by half a block at most, and by a word for
#: some of its blocks, as they differ by one.
BLOCK_WORDS, LEAST_BLOCKS = 65_536, 1024
#: Blocks of a shard.
SHARD_BLOCKS = 64
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source and a document are taken so many times at most.
MOST_TIMES = 3
SEED = 7
#: Levels of the tree between two shuffles of its nodes; nodes of one task double with each.
_LEVELS = 6
_STEP = 4096


def n_words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` out of `total` are among the `good` ones, by inversion at u.
    The probabilities are added up from 12 standard deviations below the mean to 12
    above it, what lies beyond being under the precision of a double."""
    good_, total_, draws_ = (c.cast("double") for c in (good, total, draws))
    mean = F.when(total > 0, draws_ * good_ / total_).otherwise(F.lit(0.0))
    spread = mean * (1 - good_ / F.greatest(total_, F.lit(1.0))) * (total_ - draws_) / F.greatest(total_ - 1, F.lit(1.0))
    reach = F.ceil(12 * F.sqrt(F.greatest(spread, F.lit(0.0)))) + 12
    zero = F.lit(0).cast("bigint")
    low = F.greatest(zero, draws - (total - good), F.floor(mean) - reach)
    high = F.least(good, draws, F.floor(mean) + reach)

    def ratio(k: Column) -> Column:
        below = (k + 1) * (total_ - good_ - draws_ + k + 1)
        return F.when(below > 0, (good_ - k) * (draws_ - k) / below).otherwise(F.lit(0.0))

    one, none = F.lit(1.0).alias("w"), F.lit(0.0)
    whole = F.aggregate(
        F.sequence(low, high), F.struct(one, none.alias("sum")),
        lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"],
    )
    return _let(whole * u, lambda goal: F.aggregate(
        F.sequence(low, high), F.struct(one, none.alias("sum"), low.alias("at")),
        lambda s, k: F.struct(
            (s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum"), F.when(s["sum"] <= goal, k).otherwise(s["at"]).alias("at")
        ), lambda s: s["at"],
    ))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def split(quotas: Column, total: Column, draws: Column, *node: Column) -> Column:
    """A multivariate hypergeometric draw: of each source's quota, how many blocks are
    among `draws` out of the node's `total`. One source after another, each from what
    is left."""
    start = F.struct(total.cast("bigint").alias("rest"), draws.cast("bigint").alias("draws"), F.array().cast("array<bigint>").alias("out"))
    numbered = F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i")))

    def step(state: Column, source: Column) -> Column:
        drawn = hypergeometric(source["q"], state["rest"], state["draws"], uniform(*node, source["i"]))
        return _let(drawn, lambda k: F.struct(
            (state["rest"] - source["q"]).alias("rest"), (state["draws"] - k).alias("draws"), F.concat(state["out"], F.array(k)).alias("out")
        ))

    return F.aggregate(numbered, start, step, lambda state: state["out"])


def shares(sources: DataFrame, most_times: int = MOST_TIMES) -> DataFrame:
    """sources (size, weight, ...), a written table, with target: all words shared by
    weight, at most most_times a source's size, the excess shared by weight among the
    others until none is above. Each round is one aggregation over the sources."""
    exact = "decimal(38,0)"
    size, weight = F.col("size").cast(exact), F.col("weight").cast(exact)
    total = sources.agg(F.sum(size)).first()[0] or 0
    full, seen = F.lit(False), -1
    while True:
        row = sources.agg(
            F.sum(F.when(full, size * most_times)).alias("held"), F.sum(F.when(~full, weight)).alias("weights"), F.count_if(full).alias("n")
        ).first()
        rest, weights = int(total) - int(row["held"] or 0), int(row["weights"] or 1)
        share = weight * F.lit(rest).cast(exact)
        if row["n"] == seen:
            target = F.when(full, (size * most_times).cast("double")).otherwise(share.cast("double") / F.lit(float(weights)))
            return sources.withColumn("target", target)
        seen = row["n"]
        full = share > size * F.lit(most_times * weights).cast(exact)


def _sources(runs: DataFrame, weights: Sequence[int], block_words: int, least_blocks: int, most_times: int) -> DataFrame:
    """(no, source, size, weight, target, blocks, quota), written: one row for a source."""
    named = in_order(runs.groupBy("source").agg(F.first("total").alias("size")), F.col("source").asc_nulls_last())
    order = stretches(named, []).select("part", "first", "before")
    no = (F.col("before") + F.col("_at") - F.col("first")).alias("no")
    ranked = materialise(
        named.join(order, part_of("_at") == F.col("part"))
        .select(no, "source", "size", F.get(F.array(*map(F.lit, weights)), (no % len(weights)).cast("int")).alias("weight"))
    )
    blocks = F.least("size", F.greatest(F.lit(least_blocks).cast("bigint"), F.ceil(F.col("size") / F.lit(block_words))))
    quota = F.round(F.col("target") * F.col("blocks") / F.greatest("size", F.lit(1))).cast("bigint")
    found = materialise(shares(ranked, most_times).withColumn("blocks", blocks).withColumn("quota", F.least(quota, F.col("blocks") * most_times)))
    forget(named)
    forget(ranked)
    return found


def _until(rows: DataFrame, count: str, name: str) -> DataFrame:
    """Each row for name = 0, 1, ... below its count, in steps, so that no row holds
    a long list and the rows of a large count come from many tasks."""
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, F.lit(_STEP).cast("bigint"))).alias("_from")
    steps = rows.where(F.col(count) > 0).select("*", step).repartition("no", "_from")
    last = F.least(F.col("_from") + (_STEP - 1), F.col(count) - 1)
    return steps.select("*", F.explode(F.sequence("_from", last)).alias(name)).drop("_from")


def _shards(sources: DataFrame, shard_blocks: int) -> DataFrame:
    """(no, draw, shard): which shard each draw of a source belongs to."""
    spark = sources.sparkSession
    blocks = int(sources.agg(F.sum("quota")).first()[0] or 0)
    shards = max(1, -(-blocks // shard_blocks))
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("no", "quota"))), lambda s: s["quota"]).alias("quotas")
    whole = sources.agg(quotas).select(
        F.lit(0).cast("bigint").alias("low"), F.lit(shards).cast("bigint").alias("high"), "quotas",
        F.transform("quotas", lambda _: F.lit(0).cast("bigint")).alias("starts"),
    )

    def before(shard: Column) -> Column:
        return F.floor(shard.cast("decimal(38,0)") * F.lit(blocks) / F.lit(shards)).cast("bigint")

    nodes, low, high = whole, F.col("low"), F.col("high")
    middle = F.floor((low + high) / 2)
    for level in range((shards - 1).bit_length()):
        if level % _LEVELS == _LEVELS - 1:
            nodes = nodes.repartition("low")
        drawn = split(F.col("quotas"), before(high) - before(low), before(F.col("middle")) - before(low), low, high)
        halved = nodes.withColumn("middle", middle).withColumn("left", F.when(high - low > 1, drawn))
        left = F.struct(low.alias("low"), F.col("middle").alias("high"), F.col("left").alias("quotas"), "starts")
        right = F.struct(
            F.col("middle").alias("low"), high.alias("high"), F.zip_with("quotas", "left", lambda q, k: q - k).alias("quotas"),
            F.zip_with("starts", "left", lambda s, k: s + k).alias("starts"),
        )
        same = F.struct("low", "high", "quotas", "starts")
        nodes = halved.select(F.explode(F.when(high - low > 1, F.array(left, right)).otherwise(F.array(same))).alias("n")).select("n.*")
    owned = nodes.select(low.alias("shard"), F.posexplode(F.arrays_zip("quotas", "starts")).alias("no", "x")).where("x.quotas > 0")
    draws = F.sequence(F.col("x.starts"), F.col("x.starts") + F.col("x.quotas") - 1)
    return owned.select(F.col("no").cast("bigint").alias("no"), "shard", F.explode(draws).alias("draw"))


def _draws(sources: DataFrame) -> DataFrame:
    """(no, draw, epoch, block): each pass over a source takes its blocks in an order
    of its own; draws are numbered across passes, up to the quota."""
    passes = _until(sources.select("no", "blocks", "quota"), "blocks", "block")
    epochs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("quota") - 1) / F.col("blocks")))
    every = passes.where("quota > 0").select("no", "blocks", "quota", "block", F.explode(epochs).alias("epoch"))
    order = [F.col("no"), F.col("epoch"), F.xxhash64(F.lit(SEED), "no", "epoch", "block"), F.col("block")]
    placed = in_order(every, *order)
    runs = stretches(placed, ["no", "epoch"]).select("part", F.col("no").alias("_no"), F.col("epoch").alias("_epoch"), "first", "before")
    same = (part_of("_at") == F.col("part")) & (F.col("no") == F.col("_no")) & (F.col("epoch") == F.col("_epoch"))
    draw = F.col("epoch") * F.col("blocks") + F.col("before") + F.col("_at") - F.col("first")
    return placed.join(runs, same).select("no", "epoch", "block", "quota", draw.alias("draw")).where("draw < quota")


def _start(block: Column) -> Column:
    """The first word of a block of a source of `size` words in `blocks` blocks."""
    return block * F.floor(F.col("size") / F.col("blocks")) + F.least(block, F.col("size") % F.col("blocks"))


def _block_of(word: Column) -> Column:
    each, longer = F.floor(F.col("source_size") / F.col("blocks")), F.col("source_size") % F.col("blocks")
    return F.when(word < longer * (each + 1), F.floor(word / (each + 1))).otherwise(
        longer + F.floor((word - longer * (each + 1)) / F.greatest(each, F.lit(1)))
    )


def _mixed(
    docs: DataFrame, weights: Sequence[int], block_words: int, least_blocks: int, shard_blocks: int, most_times: int
) -> tuple[DataFrame, DataFrame]:
    """The documents in their sources' order (row, doc_id, source, size, source_size,
    target), and the words that each shard takes of them."""
    sized = materialise(docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.lit(SEED), "doc_id", "text").alias("_hash"), F.monotonically_increasing_id().alias("_row"),
    ))
    placed = in_order(sized, F.col("source").asc_nulls_last(), F.col("_hash"), F.col("doc_id"), F.col("size"), F.col("_row"))
    forget(sized)
    runs = materialise(stretches(placed, ["source"], F.col("size")))
    sources = _sources(runs, weights, block_words, least_blocks, most_times)
    known = runs.join(sources.withColumnRenamed("source", "_name").withColumnRenamed("size", "source_size"), F.col("source").eqNullSafe(F.col("_name"))).select(
        F.col("part").alias("_part"), F.col("source").alias("_owner"), F.col("before"), "no", "source_size", "target", "blocks"
    )
    part = part_of("_at")
    earlier = Window.partitionBy("_here", "source").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    rows = placed.withColumn("_here", part).withColumn("_within", within).join(
        known, (F.col("_here") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_owner"))
    )
    rows = materialise(rows.select(
        F.col("_at").alias("row"), "doc_id", "source", "size", "source_size", "target", "no", "blocks", (F.col("before") + F.col("_within")).alias("offset")
    ))
    low, high = F.col("offset"), F.col("offset") + F.col("size")
    held = rows.where("size > 0").select(
        "row", "doc_id", "source", "no", low.alias("low"), high.alias("high"), F.explode(F.sequence(_block_of(low), _block_of(high - 1))).alias("block")
    )
    spans = _draws(sources).join(_shards(sources, shard_blocks), ["no", "draw"]).join(sources.select("no", "size", "blocks"), "no").select(
        F.col("no").alias("_no"), F.col("block").alias("_block"), "epoch", "shard", "draw", _start(F.col("block")).alias("from"), _start(F.col("block") + 1).alias("to")
    )
    start, stop = F.greatest("low", "from"), F.least("high", "to")
    taken = held.join(materialise(spans), (F.col("no") == F.col("_no")) & (F.col("block") == F.col("_block"))).select(
        "shard", "source", "no", "draw", "epoch", "block", "row", "doc_id", (start - F.col("low")).alias("start"), (stop - start).alias("words")
    )
    forget(placed)
    return rows, taken


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS,
    shard_blocks: int = SHARD_BLOCKS, most_times: int = MOST_TIMES,
) -> DataFrame:
    """The mix: per output shard the passages it holds, in shuffled order: shard, place,
    source, epoch, block, doc_id, start (words of the document before it), words.

    See taken() for weights, targets and odd rows. A shard holds shard_blocks blocks,
    one less at most; a block's passages stay together and in order. One row holds a
    number for every source, so the sources of a mix should be thousands at most; all
    else is dealt out by block.
    """
    _, found = _mixed(docs, weights, block_words, least_blocks, shard_blocks, most_times)
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "shard", "no", "draw"), "no", "draw", "row")
    return found.withColumn("place", F.row_number().over(order)).select("shard", "place", "source", "epoch", "block", "doc_id", "start", "words")


def taken(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS,
    shard_blocks: int = SHARD_BLOCKS, most_times: int = MOST_TIMES,
) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    Sources in code point order, null last, weigh 5, 2, 1, repeating, and share as many
    words as there are; a target stops at most_times its source's size and the excess
    is shared by weight. A source gives its target rounded to whole blocks, and a
    document at most most_times its size.

    Null, empty and blank texts have size 0 and give nothing; a source of such texts
    alone has target 0. A very long text spans several blocks. Rows that repeat, and
    rows with a null doc_id, are documents of their own; the order within a source
    follows from the contents, so reruns agree. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows, found = _mixed(docs, weights, block_words, least_blocks, shard_blocks, most_times)
    sums = found.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
