"""A triple table and the graph operations over it.

triples has s, p, o, o_kind ('iri', 'literal' or 'bnode'), g. Patterns become
joins that Catalyst orders; transitive closures double their reach each round,
over distinct pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


def triples(rows: DataFrame, subject: Column, properties: dict[str, Column], kinds: dict[str, str] | None = None, graph: str | None = None) -> DataFrame:
    """One triple per non-null property."""
    kinds = kinds or {}
    items = F.array(*[
        F.struct(F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit(kinds.get(p, "literal")).alias("o_kind")) for p, value in properties.items()
    ])
    found = rows.select(subject.alias("s"), F.explode(items).alias("x"))
    return found.select("s", "x.p", "x.o", "x.o_kind", F.lit(graph).alias("g")).where("o is not null")


def match(data: DataFrame, patterns: Sequence[Pattern], optional: Sequence[Sequence[Pattern]] = (), graph: str | None = None) -> DataFrame:
    """Solutions of a basic graph pattern; terms that start with ? are variables.
    Patterns with most constants come first; each optional group is one left join,
    so its variables are bound together or not at all."""
    if graph is not None:
        data = data.where(F.col("g") == graph)

    def one(pattern: Pattern) -> DataFrame:
        found, names = data, {}
        for place, term in zip(("s", "p", "o"), pattern):
            if not term.startswith("?"):
                found = found.where(F.col(place) == term)
            elif term[1:] in names:
                found = found.where(F.col(place) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = place
        return found.select(*[F.col(place).alias(name) for name, place in names.items()])

    def together(group: Sequence[Pattern]) -> DataFrame:
        ordered = sorted(group, key=lambda t: sum(x.startswith("?") for x in t))
        joined = one(ordered.pop(0))
        while ordered:
            at = next((i for i, t in enumerate(ordered) if {x[1:] for x in t if x[0] == "?"} & set(joined.columns)), 0)
            part = one(ordered.pop(at))
            shared = [c for c in part.columns if c in joined.columns]
            joined = joined.join(part, shared) if shared else joined.crossJoin(part)
        return joined

    found = together(patterns)
    for group in optional:
        part = together(group)
        found = found.join(part, [c for c in part.columns if c in found.columns], "left")
    return found


def compatible_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on shared variables that are equal or unbound on either side.

    Solutions that bind every shared variable meet in an equality join. Only those
    that leave one unbound are compared by the whole rule, which their semantics
    want: an unbound variable goes with every value. Without shared variables the
    result is the product of both sides.
    """
    shared = [c for c in a.columns if c in b.columns]
    right = b.select(*[F.col(c).alias(f"_{c}") for c in b.columns])
    both = lambda x, y: x & y
    rule = reduce(both, [(F.col(c) == F.col(f"_{c}")) | F.col(c).isNull() | F.col(f"_{c}").isNull() for c in shared], F.lit(True))
    bound_a = reduce(both, [F.col(c).isNotNull() for c in shared], F.lit(True))
    bound_b = reduce(both, [F.col(f"_{c}").isNotNull() for c in shared], F.lit(True))
    if shared:
        equal = reduce(both, [F.col(c) == F.col(f"_{c}") for c in shared])
        met = a.where(bound_a).join(right.where(bound_b), equal)
        met = met.unionByName(a.where(~bound_a).join(right, rule)).unionByName(a.where(bound_a).join(right.where(~bound_b), rule))
    else:
        met = a.crossJoin(right)
    return met.select(
        *[F.coalesce(c, f"_{c}").alias(c) if c in shared else F.col(c) for c in a.columns],
        *[F.col(f"_{c}").alias(c) for c in b.columns if c not in shared],
    )


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Solutions of a that no compatible solution of b shares a variable with."""
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b.select(*shared).distinct(), shared, "left_anti") if shared else a


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(child, parent, depth): all ancestors with their smallest depth; on a cycle a
    node is its own ancestor. Null ends are ignored.

    Each round joins the pairs of depth exactly d, the longest known, with all known
    pairs, and so finds those of depth d + 1 to 2 d: every shortest path has a node
    at distance d. The rounds are the logarithm of the longest shortest path, and a
    round's work follows the pairs it finds, not the paths between them.
    """
    from quarry.session import materialise

    first = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    known = materialise(first.withColumn("depth", F.lit(1)))
    parts, reach = [known], 1
    while True:
        longest = parts[-1].where(F.col("depth") == reach).select("child", F.col("parent").alias("middle"))
        onward = known.select(F.col("child").alias("middle"), "parent", (F.col("depth") + reach).alias("depth"))
        found = longest.join(onward, "middle").groupBy("child", "parent").agg(F.min("depth").alias("depth"))
        new = materialise(found.join(known.select("child", "parent"), ["child", "parent"], "left_anti"))
        if new.isEmpty():
            return known
        parts.append(new)
        known, reach = known.union(new), 2 * reach


def update(data: DataFrame, delete: DataFrame | None = None, insert: DataFrame | None = None) -> DataFrame:
    """Set difference, then union: the semantics of a delete-insert request."""
    found = data.subtract(delete.select(*data.columns)) if delete is not None else data
    return found.union(insert.select(*data.columns)).distinct() if insert is not None else found


def clear(data: DataFrame, graph: str) -> DataFrame:
    return data.where(~F.col("g").eqNullSafe(F.lit(graph)))


def copy(data: DataFrame, source: str, target: str) -> DataFrame:
    """target becomes source's triples."""
    return clear(data, target).union(data.where(F.col("g") == source).withColumn("g", F.lit(target)).select(*data.columns)).distinct()


def move(data: DataFrame, source: str, target: str) -> DataFrame:
    return clear(copy(data, source, target), source)


def add(data: DataFrame, source: str, target: str) -> DataFrame:
    """source's triples join those of target."""
    return data.union(data.where(F.col("g") == source).withColumn("g", F.lit(target)).select(*data.columns)).distinct()


def load(data: DataFrame, lines: DataFrame, graph: str | None = None, column: str = "value") -> DataFrame:
    """data with the statements of N-Quads or N-Triples lines; graph names the graph
    of statements that name none."""
    found = parse_nquads(lines, column).withColumn("g", F.coalesce("g", F.lit(graph)))
    return data.union(found.select(*data.columns)).distinct()


def create(graphs: DataFrame, graph: str, silent: bool = False) -> DataFrame:
    """The registry of graphs (column g) with one more, an empty graph included;
    an error if it exists, unless silent."""
    if not silent and not graphs.where(F.col("g") == graph).isEmpty():
        raise ValueError(f"graph {graph} exists")
    return graphs.union(graphs.sparkSession.createDataFrame([(graph,)], "g string")).distinct()


def drop(data: DataFrame, graphs: DataFrame, graph: str, silent: bool = False) -> tuple[DataFrame, DataFrame]:
    """Triples and registry without a graph; an error if it is unknown, unless silent."""
    if not silent and graphs.where(F.col("g") == graph).isEmpty():
        raise ValueError(f"no graph {graph}")
    return clear(data, graph), graphs.where(F.col("g") != graph)


def delete_where(data: DataFrame, patterns: Sequence[Pattern], graph: str | None = None) -> DataFrame:
    """data without the triples of every solution of the patterns."""
    found = match(data, patterns, graph=graph)
    gone = None
    for pattern in patterns:
        terms = [F.col(t[1:]) if t.startswith("?") else F.lit(t) for t in pattern]
        rows = found.select(*[term.alias(f"_{c}") for term, c in zip(terms, "spo")]).distinct()
        gone = rows if gone is None else gone.union(rows).distinct()
    within = F.lit(True) if graph is None else F.col("g") == graph
    rule = (F.col("s") == F.col("_s")) & (F.col("p") == F.col("_p")) & (F.col("o") == F.col("_o")) & within
    return data.join(gone, rule, "left_anti")


NQUAD = r'^(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(\S+))?)\s*(?:<([^>]*)>\s*)?\.\s*$'


def parse_nquads(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o, o_kind, o_datatype, o_lang, g) of statement lines; others are dropped."""
    part = lambda n: F.nullif(F.regexp_extract(column, NQUAD, n), F.lit(""))
    kind = F.when(part(4).isNotNull(), "iri").when(part(5).isNotNull(), "bnode").otherwise("literal")
    return lines.where(F.col(column).rlike(NQUAD)).select(
        F.coalesce(part(1), part(2)).alias("s"), part(3).alias("p"),
        F.coalesce(part(4), part(5), F.regexp_extract(column, NQUAD, 6)).alias("o"), kind.alias("o_kind"),
        part(7).alias("o_datatype"), part(8).alias("o_lang"), part(9).alias("g"),
    )


def to_turtle(data: DataFrame) -> DataFrame:
    """One statement line per triple."""
    from quarry.functions.text import escape_turtle

    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escape_turtle(F.col("o")), F.lit('"'))).otherwise(node("o"))
    return data.select(F.concat_ws(" ", node("s"), node("p"), value, F.lit(".")).alias("value"))


def subject_documents(data: DataFrame) -> DataFrame:
    """(s, predicates): a map from predicate to the list of its values with graph."""
    per = data.groupBy("s", "p").agg(F.array_sort(F.collect_set(F.struct(F.col("o").alias("value"), F.col("g").alias("graph")))).alias("values"))
    return per.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "values")))).alias("predicates"))


def whitelisted(data: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """Triples whose graph lists their predicate: a semi join with a small rule table."""
    pairs = data.sparkSession.createDataFrame([(g, p) for g, ps in rules.items() for p in ps], "g string, p string")
    return data.join(F.broadcast(pairs), ["g", "p"], "left_semi").select(*data.columns)


RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def indexable(data: DataFrame, text_types: Sequence[str] = ("string", "langString")) -> DataFrame:
    """Statements a text index takes: no blank subjects; string literals, and any
    object of rdf:type."""
    plain = F.col("o_datatype").isNull() | F.substring_index("o_datatype", "#", -1).isin(*text_types)
    text = (F.col("o_kind") == "literal") & plain
    return data.where(~F.col("s").startswith("_:") & (text | (F.col("p") == RDF_TYPE)))


def indexable_properties(records: DataFrame, edges: bool = False) -> DataFrame:
    """Property-graph records (type, dataType) with string values; edges on request."""
    kinds = ["vl", "vp", "e", "ep"] if edges else ["vl", "vp"]
    return records.where(F.col("type").isin(*kinds) & (F.col("dataType") == "String"))


class Ontology:
    """Lookups over the triples of an ontology."""

    def __init__(self, data: DataFrame, label: str = "name", parent: str = "within"):
        self.data, self.label, self.parent = data, label, parent

    def by_type(self, kind: str) -> DataFrame:
        return self.data.where((F.col("p") == RDF_TYPE) & (F.col("o") == kind)).select("s")

    def by_uri(self, uri: str) -> DataFrame:
        return self.data.where(F.col("s") == uri).select("p", "o")

    def by_label(self, text: str, edits: int = 2) -> DataFrame:
        """Concepts whose label contains the text or is a few edits from it."""
        low = F.lower("o")
        near = low.contains(text.lower()) | (F.levenshtein(low, F.lit(text.lower())) <= edits)
        return self.data.where((F.col("p") == self.label) & near).select("s", F.col("o").alias("label"))

    def relations(self, uri: str) -> DataFrame:
        """Links from and to a concept."""
        out = self.data.where((F.col("s") == uri) & (F.col("o_kind") == "iri")).select(F.lit("out").alias("direction"), "p", F.col("o").alias("other"))
        return out.union(self.data.where((F.col("o") == uri) & (F.col("o_kind") == "iri")).select(F.lit("in"), "p", "s"))

    def problems(self) -> DataFrame:
        """(s, problem): concepts without a label or with a parent that is none."""
        subjects = self.data.select("s").distinct()
        unlabelled = subjects.join(self.data.where(F.col("p") == self.label).select("s"), "s", "left_anti").withColumn("problem", F.lit("no_label"))
        links = self.data.where(F.col("p") == self.parent).select("s", F.col("o").alias("up"))
        lost = links.join(subjects.withColumnRenamed("s", "up"), "up", "left_anti").select("s", F.lit("unknown_parent").alias("problem"))
        return unlabelled.union(lost)

    def statistics(self) -> DataFrame:
        return self.data.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))


def gazetteer_ids(rows: DataFrame, names: DataFrame, column: str = "country") -> DataFrame:
    """rows with uri from names(name, uri), compared without case and outer blanks;
    null where there is none."""
    known = names.select(F.lower(F.trim("name")).alias("_name"), "uri").dropDuplicates(["_name"])
    return rows.withColumn("_name", F.lower(F.trim(column))).join(known, "_name", "left").drop("_name")
