"""Entity resolution: context scores, fuzzy matching, agreement metrics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions import text as T
from quarry.session import materialise


def _title_boost(title: Column, country: Column) -> Column:
    weight = C.BOOST_WEIGHTS["title"]
    boost = F.when(F.lit(False), 0.0)
    for region, (signals, codes) in C.TITLE_REGIONS.items():
        miss = -weight * 0.5 if region == "north_american" else 0.0
        boost = boost.when(T.contains_any(title, signals), F.when(F.coalesce(country.isin(*codes), F.lit(False)), weight).otherwise(miss))
    return boost.otherwise(0.0)


def context_boost(rows: DataFrame) -> DataFrame:
    """rows (ontology, entity, confidence, country, admin1, population, title,
    keywords, locations, signals) with the boosted confidence, one at most, and
    context_signals."""
    w = C.BOOST_WEIGHTS
    title = F.lower(F.coalesce("title", F.lit("")))
    places = F.transform("locations", lambda x: F.lower(x))
    joined = F.array_join(places, " ")
    names = F.when(F.lit(False), F.array().cast("array<string>"))
    for code, known in C.COUNTRY_NAMES.items():
        names = names.when(F.col("country") == code, F.array(*map(F.lit, known)))
    names = names.otherwise(F.array(F.lower("country")))
    state = (F.coalesce("admin1", F.lit("")) != "") & F.exists(places, lambda x: x.contains(F.lower("admin1")))
    nation = F.col("country").isNotNull() & F.exists(names, lambda x: joined.contains(x))
    people = F.coalesce("population", F.lit(0))
    geographic = (
        _title_boost(title, F.col("country")) + F.when(state, w["cooccurrence"]).otherwise(0.0) + F.when(nation, w["cooccurrence"] * 0.8).otherwise(0.0)
        + F.when(people > 1_000_000, w["type"]).when(people > 100_000, w["type"] * 0.5).otherwise(0.0)
        + F.when(F.array_contains("signals", "geographic:country_context"), w["semantic"]).otherwise(0.0)
        + F.when(F.array_contains("signals", "geographic:regional_directional"), w["semantic"] * 0.5).otherwise(0.0)
    )
    about = F.lower(F.concat_ws(" ", "title", F.array_join("keywords", " ")))
    general = F.when(about.contains(F.lower("entity")), w["title"] * 0.5).otherwise(0.0)
    boost = F.when(F.col("ontology") == "geonames", geographic).otherwise(general)
    found = F.array_compact(
        F.array(
            F.when(T.contains_any(title, ("north american", "usa")), "doc_north_american_context").when(T.contains_any(title, ("european", "europe")), "doc_european_context")
            .when(T.contains_any(title, ("asian", "asia")), "doc_asian_context"),
            F.when(F.size("locations") > 1, F.concat(F.lit("co_occurrence_with_"), F.size("locations"), F.lit("_locations"))),
        )
    )
    semantic = F.transform(F.slice("signals", 1, 3), lambda s: F.concat(F.lit("semantic_"), s))
    city = F.array_compact(F.array(F.when(people > 1_000_000, "major_city_population").when(people > 100_000, "medium_city_population")))
    return rows.withColumn("context_signals", F.concat(found, semantic, city)).withColumn("confidence", F.least(F.col("confidence") + boost, F.lit(1.0)))


def routed(entities: DataFrame, types: list[str], enabled: bool = True) -> DataFrame:
    """Contextual alignment keeps only entities of the listed types; without it all go the basic way."""
    if not enabled:
        return entities.withColumn("route", F.lit("basic"))
    return entities.where(F.col("type").isin(*types)).withColumn("route", F.lit("contextual"))


def match_kind(text: Column, concept: Column) -> Column:
    """struct(kind, confidence): exact, containment, or word overlap over 0.3; else null."""
    a, b = T.normalise_for_match(text), T.normalise_for_match(concept)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    overlap = F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))
    pick = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("confidence"))
    return (
        F.when(a == b, pick("exact", F.lit(1.0))).when(a.contains(b) | b.contains(a), pick("partial", ratio))
        .when(overlap > 0.3, pick("word_overlap", overlap))
    )


def best_matches(texts: DataFrame, concepts: DataFrame, k: int) -> DataFrame:
    """(text, concept, kind, confidence): the k best of concepts (concept) for each
    text (text); what is empty once normalised matches nothing.

    No pair is compared that cannot match: a match shares a word, or one side holds
    the other and with it its first three characters (all, if it has fewer). Both
    are equality joins.
    """
    a, b = T.normalise_for_match(F.col("text")), T.normalise_for_match(F.col("concept"))
    mine, theirs = texts.select("text", a.alias("a")).where("a != ''"), concepts.select("concept", b.alias("b")).where("b != ''")
    words = lambda c: F.explode(F.array_distinct(F.split(c, " ")))

    def pieces(c: str) -> Column:
        spots = F.sequence(F.lit(1), F.length(c))
        return F.explode(F.array_distinct(F.flatten(F.transform(spots, lambda i: F.array(*[F.substring(F.col(c), i, F.lit(n)) for n in (1, 2, 3)])))))

    start = lambda c: F.substring(c, 1, 3)
    shared = mine.select("text", words("a").alias("key")).join(theirs.select("concept", words("b").alias("key")), "key")
    held = mine.select("text", "a", pieces("a").alias("key")).join(theirs.select("concept", "b", start("b").alias("key")), "key").where(F.contains("a", "b"))
    holds = theirs.select("concept", "b", pieces("b").alias("key")).join(mine.select("text", "a", start("a").alias("key")), "key").where(F.contains("b", "a"))
    pairs = reduce(DataFrame.union, [p.select("text", "concept") for p in (shared, held, holds)]).distinct()
    hits = pairs.withColumn("m", match_kind(F.col("text"), F.col("concept"))).where("m is not null")
    nth = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("m.confidence"), "concept"))
    return hits.withColumn("r", nth).where(F.col("r") <= k).select("text", "concept", "m.kind", "m.confidence")


def keyword_concepts(docs: DataFrame, low: Column) -> DataFrame:
    """docs with one row per hit (category, concept, evidence) of the keyword rules in
    the lower-cased text low; the evidence names the rule's first keyword."""
    hits = [
        F.when(
            T.contains_any(low, [w.lower() for w in words]),
            F.struct(F.lit(category).alias("category"), F.lit(concept).alias("concept"), F.lit(f"Keyword match: {words[0]}").alias("evidence")),
        )
        for category, rules in C.CONCEPT_KEYWORDS.items() for concept, words in rules.items()
    ]
    return docs.withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).drop("low")


_RULES = [(re.compile(p, re.I), new) for p, new in C.ORG_RULES]


def _normalised(name: str) -> str:
    for pattern, new in _RULES:
        name = pattern.sub(new, name)
    return " ".join(name.split())


def name_similarity(a: str, b: str) -> float:
    """Matching-block ratio of the normalised, lower-cased base names."""
    return SequenceMatcher(None, _normalised(a.lower()), _normalised(b.lower())).ratio()


def _pieces(text: str, size: int) -> list[str]:
    """All pieces of size neighbouring characters, each with its how-manieth occurrence."""
    seen: Counter[str] = Counter()
    out = []
    for at in range(len(text) - size + 1):
        piece = text[at : at + size]
        seen[piece] += 1
        out.append(f"{size}{piece}{seen[piece]}")
    return out


def _prefixes(texts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """texts (keys, norm) with size and, one row each, the rarest pieces by which a
    text must meet every text of a ratio of threshold or more: piece, place, need.

    For a ratio of t, texts of s characters together have t * s / 2 characters in
    common, in one block more than characters are left over at most, so at least
    need = (1.5 * t - 1) * s - 1 pairs of characters, and the shorter one has
    t * s / 2 characters. Where that need may be zero, single characters serve
    too. Of n pieces, need of which are common, one of the first n - need + 1
    in an order that all texts share is common; rare pieces come first.
    """
    rate, least = 1.5 * threshold - 1, threshold / (2 - threshold)
    short = 1 / rate if rate > 0 else float("inf")

    @F.pandas_udf("array<struct<piece:string,n:int,need:double>>")
    def pieces(norms: pd.Series) -> pd.Series:
        def of(norm: str) -> list[dict]:
            both = len(norm) * (1 + least)  # with the shortest text that may match
            sets = [(2, both * rate - 1)] if both * rate > 1 else []
            sets += [(1, both * threshold / 2)] if both * least <= short else []  # a partner may have no pairs
            return [{"piece": g, "n": len(norm) - size + 1, "need": need} for size, need in sets for g in _pieces(norm, size)]

        return norms.map(of)

    held = materialise(texts.withColumn("size", F.length("norm")).select("*", F.inline(pieces("norm"))))
    counts = materialise(held.groupBy("piece").agg(F.count(F.lit(1)).alias("texts")))
    order = Window.partitionBy(*keys, "norm", F.substring("piece", 1, 1)).orderBy("texts", "piece")
    placed = held.join(counts, "piece").withColumn("place", F.row_number().over(order))
    return materialise(placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("need") - 1e-9) + 1).drop("texts", "need"))


def near_texts(texts: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, norm, other): ordered pairs of different texts (norm) that agree in keys,
    of a matching-block ratio of threshold or more. No pair is missed.

    A prefix join proposes pairs: a piece that most texts hold is not among the
    rarest of a text, unless what most texts hold is over half of it (at 0.85).
    The pieces that two texts can still share behind the one they meet by must suffice. Both sides are plain shuffles, so a frequent piece
    can be split. The ratio is taken once for each pair and direction.
    """

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            m = SequenceMatcher(None, x, y)
            out.append(m.quick_ratio() >= threshold and m.ratio() >= threshold)
        return pd.Series(out, dtype=bool)

    mine = _prefixes(texts, keys, threshold)
    other = mine.select(*keys, "piece", F.col("norm").alias("other"), F.col("size").alias("size_b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"))
    total = F.col("size") + F.col("size_b")
    need = F.when(F.substring("piece", 1, 1) == "2", total * (1.5 * threshold - 1) - 1).otherwise(total * threshold / 2)
    pairs = (
        mine.join(other, [*keys, "piece"]).where(F.col("norm") < F.col("other"))
        .where(F.least("size", "size_b") * 2 >= total * threshold - 1e-9)
        .where(1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) >= need - 1e-9)
        .select(*keys, "norm", "other").distinct()
    )
    both = F.explode(F.array(F.struct("norm", "other"), F.struct(F.col("other").alias("norm"), F.col("norm").alias("other"))))
    return pairs.select(*keys, both.alias("pair")).select(*keys, "pair.*").where(near("norm", "other"))


def first_fit(edges: DataFrame) -> DataFrame:
    """(node, head) of the nodes that an earlier one takes: the groups of a greedy pass
    in ascending order, in which every node not yet taken becomes a head and takes
    all later nodes that an edge (a, b) with a < b leads to.

    In rounds: whoever has no earlier neighbour left is a head, so its neighbours
    are taken and leave with their edges. As many rounds as the longest chain in which
    each node waits for the one before; all independent groups go on at once.
    """
    edges = materialise(edges.select("a", "b").where("a < b").distinct())
    taken, left = [], edges
    while not left.isEmpty():
        heads = materialise(left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"))
        gone = materialise(left.join(heads, "a", "left_semi").select("b").distinct())
        taken.append(gone)
        left = materialise(left.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
    if not taken:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("head"))
    gone = materialise(reduce(DataFrame.union, taken)).withColumnRenamed("b", "a")
    return edges.join(gone, "a", "left_anti").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("head"))


def similar_names(names: DataFrame, threshold: float = 0.85, block: Column | None = None) -> DataFrame:
    """(canonical, name): groups of similar names (column name), greedy in sorted
    order, compared only when both lack a country or share it; all names with one
    another, or those of a block if one is given. Null names are left out.

    Names of one normalised base and country have the same neighbours and are one
    node, named by its smallest name; its other names share its fate. A country's
    node meets its own country's and those without one, so nodes of one base
    are joined by a line for each country and not by all pairs.
    """

    @F.pandas_udf("string")
    def normalised(bases: pd.Series) -> pd.Series:
        return bases.map(lambda n: _normalised(n.lower()))

    rows = materialise(names.select("name").where("name is not null").distinct().select(
        "name", T.base_name(F.col("name")).alias("base"), F.coalesce(T.country_of(F.col("name")), F.lit("")).alias("country"), (F.lit("") if block is None else block).alias("block")
    ).withColumn("norm", normalised("base")))
    nodes = materialise(rows.groupBy("block", "norm", "country").agg(F.min("name").alias("node")))
    near = materialise(near_texts(nodes.select("block", "norm").distinct(), ["block"], threshold))
    same = nodes.groupBy("block", "norm").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block", "norm", F.col("norm").alias("other"))
    mine = nodes.withColumnRenamed("node", "a").join(near.union(same), ["block", "norm"])
    theirs = nodes.select("block", F.col("norm").alias("other"), F.col("country").alias("country_b"), F.col("node").alias("b"))
    abroad = mine.where("country <> ''")
    edges = [
        mine.join(theirs.withColumnRenamed("country_b", "country"), ["block", "other", "country"]).select("a", "b"),
        mine.where("country = ''").join(theirs.where("country_b <> ''"), ["block", "other"]).select("a", "b"),
        abroad.join(theirs.where("country_b = ''"), ["block", "other"]).select("a", "b"),
    ]
    taken = materialise(first_fit(reduce(DataFrame.union, edges)))
    placed = nodes.join(taken, "node", "left").select("block", "norm", "country", F.coalesce("head", "node").alias("head"))
    members = materialise(rows.join(materialise(placed), ["block", "norm", "country"]).select("head", "name", "base"))
    groups = members.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", F.struct(F.length("base"), "name")).alias("canonical")).where("n > 1")
    return members.join(materialise(groups), "head").select("canonical", "name")


def best_names(groups: DataFrame) -> DataFrame:
    """(canonical, best): the member with the fewest all-capital tokens, then the longest."""
    capitals = F.size(F.regexp_extract_all("name", F.lit(r"\b([A-Z]{2,})\b"), F.lit(1)))
    return groups.groupBy("canonical").agg(F.min_by("name", F.struct(capitals, -F.length("name"), "name")).alias("best"))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(T.tokens(a, 1)), F.array_distinct(T.tokens(b, 1))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def text_quality(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    ratio = F.when(longest == 0, 0.0).otherwise(F.least(F.length(a), F.length(b)) / longest)
    return 0.6 * word_jaccard(a, b) + 0.4 * ratio


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """precision, recall and f1 of two lists of texts: distinct lowered texts in
    common over the raw sizes of the lists."""
    common = left.select(F.lower("text").alias("t")).distinct().join(right.select(F.lower("text").alias("t")).distinct(), "t", "left_semi").agg(F.count(F.lit(1)).alias("common"))
    sizes = left.agg(F.count(F.lit(1)).alias("n")).join(right.agg(F.count(F.lit(1)).alias("m"))).join(common)
    p = F.when(F.col("m") == 0, 0.0).otherwise(F.col("common") / F.col("m"))
    r = F.when(F.col("n") == 0, 0.0).otherwise(F.col("common") / F.col("n"))
    return sizes.select(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def embed(rows: DataFrame, model, column: str = "text", size: int = 64, batch: int = 25, most: int = 8000) -> DataFrame:
    """rows with embedding from a pluggable model (list of texts to list of
    vectors), called on batches of texts cut at `most` characters; a failing batch
    gives zero vectors."""
    names = [f.name for f in rows.schema]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, vectors = [(t or "")[:most] for t in frame[column]], []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    vectors += [list(map(float, v)) for v in model(part)]
                except Exception:  # noqa: BLE001  a failed batch is defined as zeros
                    vectors += [[0.0] * size] * len(part)
            yield frame.assign(embedding=vectors)[[*names, "embedding"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, embedding array<double>")


