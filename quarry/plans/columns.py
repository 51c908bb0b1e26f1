"""Names, uris, categories, typed values and routes computed from columns of the tables.

Each query's input is one expression that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions import text as T
from quarry.plans.texts import _HASHED, _SLUG
from quarry.registry import query
from quarry.session import table
from quarry.sources import readers as I


def _contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _cases(whens: dict[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in whens.items()) + f" ELSE {otherwise} END"


_ORG = """CASE p_partkey % 7 WHEN 0 THEN concat('Ministry of Health (', p_brand, ')') WHEN 1 THEN concat('Global  Insurance ', p_type)
  WHEN 2 THEN concat('Bureau of Statistics (', concat('Manufacturer#', p_size), ')') WHEN 3 THEN concat('University of ', p_type) WHEN 4 THEN concat('UNDP ', p_brand) WHEN 5 THEN p_name
  ELSE concat('Disaster management group ', p_brand) END"""
_PAIR = r"'^(.+?)\s*\(([^)]+)\)$'"


@query(
    "organisations",
    rf"""WITH p AS (SELECT p_partkey, {_ORG} AS name FROM part),
    b AS (SELECT *, CASE WHEN regexp_matches(name, {_PAIR}) THEN trim(regexp_extract(name, {_PAIR}, 1)) ELSE name END AS base, trim(regexp_extract(name, {_PAIR}, 2)) AS country,
      {_cases({_contains('lower(name)', words): f"'{kind}'" for kind, words in C.ORG_TYPES.items()}, "'unknown'")} AS kind,
      lower(regexp_replace(name, '\s*\([^)]+\)\s*$', '')) AS low FROM p)
    SELECT p_partkey, name, base, country, kind,
      {_cases({f"regexp_matches(low, '{'|'.join(patterns)}')": f"'{label}'" for label, patterns in C.ORG_CLASSES.items()}
              | {f"kind = '{kind}'": f"'{label}'" for kind, label in C.ORG_FALLBACK.items()}, "'org:Organization'")} AS class,
      'sg:Org_' || {_SLUG.format('base')} || CASE WHEN country <> '' THEN '_' || {_SLUG.format('country')} ELSE '' END AS uri,
      {_contains('lower(name)', C.GENERIC_ORG_WORDS)} AS needs_country FROM b""",
)
def organisations(spark, sf_dir):
    rows, name = table(spark, sf_dir, "part").select("p_partkey", F.expr(_ORG).alias("name")), F.col("name")
    kind = T.organisation_type(name)
    return rows.select(
        "p_partkey", "name", T.base_name(name).alias("base"), T.country_of(name).alias("country"), kind.alias("kind"),
        T.organisation_class(name, kind).alias("class"), T.organisation_uri(name).alias("uri"), T.needs_country(name).alias("needs_country"),
    )


_SHORT = """CASE p_partkey % 5 WHEN 0 THEN concat('Min of  ', p_name, ', ') WHEN 1 THEN concat('Natl Univ of ', p_brand, ' (', concat('Manufacturer#', p_size), ')') WHEN 2 THEN concat('Intl Org ', p_type, ' Ltd')
  WHEN 3 THEN concat('Dept of Gov ', p_type) ELSE concat(p_name, ' Co') END"""


def _rules(text: str) -> str:
    for pattern, new in C.ORG_RULES:
        text = f"regexp_replace({text}, '(?i){pattern}', '{new}', 'g')"
    return text


@query("normalised_names", rf"WITH p AS (SELECT p_partkey, {_SHORT} AS name FROM part) SELECT p_partkey, name, trim(regexp_replace({_rules('trim(name)')}, '\s+', ' ', 'g')) AS normalised FROM p")
def normalised_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SHORT).alias("name"))
    return rows.select("p_partkey", "name", T.normalise_organisation(F.col("name")).alias("normalised"))


_CONCEPT = """CASE p_partkey % 7 WHEN 0 THEN 'Increased Penetration' WHEN 1 THEN 'Leveraging Tech' WHEN 2 THEN concat(p_brand, ' Risk ', p_name) WHEN 3 THEN concat('Raising  ', p_type)
  WHEN 4 THEN concat(concat('Manufacturer#', p_size), 'ed Penetration') WHEN 5 THEN 'Accessibilty' ELSE concat(' ', p_name, ' Collaboration') END"""


@query(
    "normalised_concepts",
    rf"""WITH p AS (SELECT p_partkey, {_CONCEPT} AS concept FROM part), q AS (SELECT *, trim(concept) AS t, regexp_replace(trim(concept), '\s+', ' ', 'g') AS flat FROM p)
    SELECT p_partkey, concept, {_cases({"contains(t, chr(10)) OR " + _contains('t', C.MALFORMED_CONCEPT[1:]): 'NULL'} | {f"t = '{old}'": f"'{new}'" for old, new in C.CONCEPT_RULES.items()}
        | {"ends_with(flat, 'ed Penetration')": "replace(flat, 'ed Penetration', 'e Penetration')"}, 'flat')} AS canonical FROM q""",
)
def normalised_concepts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CONCEPT).alias("concept"))
    return rows.select("p_partkey", "concept", T.normalise_concept(F.col("concept")).alias("canonical"))


_RAW = "CASE s_suppkey % 6 WHEN 0 THEN concat(' ', s_name, '  b.,') WHEN 1 THEN 'NIL' WHEN 2 THEN ' n/a ' WHEN 3 THEN concat(';', s_name, ';') WHEN 4 THEN '.,;' ELSE s_name END"


@query(
    "cleaned_names",
    rf"""WITH s AS (SELECT s_suppkey, {_RAW} AS name FROM supplier)
    SELECT s_suppkey, name, CASE WHEN upper(trim(name)) NOT IN ('NIL', 'N/A', 'NULL', '') THEN nullif(regexp_replace(regexp_replace(trim(name), '\s+', ' ', 'g'), '^[.,;]+|[.,;]+$', '', 'g'), '') END AS cleaned FROM s""",
)
def cleaned_names(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_RAW).alias("name"))
    return rows.select("s_suppkey", "name", T.clean_organisation(F.col("name")).alias("cleaned"))


_ENTITY_KIND = "CASE s_suppkey % 8 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'ORGANIZATION' WHEN 3 THEN 'LOCATION' WHEN 4 THEN 'DATE' WHEN 5 THEN 'QUANTITY' WHEN 6 THEN 'NATURAL_EVENT' ELSE 'CONCEPT' END"
_ENTITY = """CASE s_suppkey % 8 WHEN 0 THEN concat('Prof. Dr ', s_name) WHEN 1 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'World Bank' WHEN s_suppkey % 3 = 1 THEN 'IPCC' ELSE 'United Nations' END
  WHEN 2 THEN concat(s_name, '  Body, Inc.') WHEN 3 THEN concat(s_nationkey, '-', s_suppkey) WHEN 4 THEN concat(s_nationkey + 1, ' May 20', s_nationkey + 10) WHEN 5 THEN concat(s_suppkey, ' km²') WHEN 6 THEN concat('Flood of ', s_suppkey)
  ELSE concat('a very long concept name that goes on for more than fifty characters ', s_name) END"""
_ESLUG = f"CASE WHEN length({_SLUG}) > 50 OR {_SLUG} = '' THEN {_HASHED} ELSE {_SLUG} END"
_UNTITLED = "trim(name)"
for _title in C.TITLES:
    _UNTITLED = rf"regexp_replace({_UNTITLED}, '(?i)\b{_title.replace('.', chr(92) + '.')}\.?\s+', '', 'g')"


@query(
    "typed_uris",
    f"""WITH e AS (SELECT s_suppkey, {_ENTITY_KIND} AS kind, {_ENTITY} AS name FROM supplier), u AS (SELECT *, {_UNTITLED} AS untitled, lower(trim(name)) AS low FROM e)
    SELECT s_suppkey, kind, name AS text, 'kr:' || CASE WHEN kind = 'PERSON' THEN 'person/' || {_ESLUG.format('untitled')}
      WHEN kind = 'ORGANIZATION' THEN 'organization/' || {_cases({f"low IN ('{full.lower()}', '{short}')": f"'{short}'" for full, short in C.ORG_ABBREVIATIONS.items()}, '(' + _ESLUG.format('trim(name)') + ')')}
      WHEN kind = 'QUANTITY' THEN 'quantity/' || {_HASHED.format('name')} ELSE replace(lower(kind), '_', '') || '/' || {_ESLUG.format('name')} END AS uri FROM u""",
)
def typed_uris(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_ENTITY_KIND).alias("kind"), F.expr(_ENTITY).alias("text"))
    return rows.select("s_suppkey", "kind", "text", T.mint_uri(F.col("kind"), F.col("text")).alias("uri"))


_CURIE = _cases(
    {f"c_custkey % {len(C.PREFIXES) + 4} = {k}": f"concat('{p}:', c_mktsegment)" for k, p in enumerate(C.PREFIXES)}
    | {f"c_custkey % {len(C.PREFIXES) + 4} = {len(C.PREFIXES)}": "concat('none:', c_name)", f"c_custkey % {len(C.PREFIXES) + 4} = {len(C.PREFIXES) + 1}": "concat(c_mktsegment, ' ', c_name)"}, "substr(c_mktsegment, 1, 2)",
)


@query(
    "curies",
    rf"""WITH c AS (SELECT c_custkey, {_CURIE} AS curie FROM customer)
    SELECT c_custkey, curie, {_cases({f"starts_with(curie, '{p}:')": f"'{space}' || substr(curie, {len(p) + 2})" for p, space in C.PREFIXES.items()}, 'curie')} AS uri,
      length(curie) >= 3 AND NOT regexp_matches(curie, '[<>"\s]') AS valid FROM c""",
)
def curies(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CURIE).alias("curie"))
    return rows.select("c_custkey", "curie", T.expand_curie(F.col("curie")).alias("uri"), T.has_uri_characters(F.col("curie")).alias("valid"))


_KIND = """CASE p_partkey % 6 WHEN 0 THEN concat('Risk Reduction, Insurance ', p_name) WHEN 1 THEN concat(p_type, ' Capital funding') WHEN 2 THEN p_name WHEN 3 THEN ''
  WHEN 4 THEN concat('prevention and coverage and financing ', p_brand) ELSE concat(upper(p_name), ' MITIGATION') END"""


@query(
    "solution_categories",
    f"""WITH p AS (SELECT p_partkey, {_KIND} AS kind FROM part), f AS (SELECT *, concat_ws('|', {', '.join(f"CASE WHEN {_contains('lower(kind)', words)} THEN '{name}' END" for name, words in C.CATEGORY_TERMS.items())}) AS found FROM p)
    SELECT p_partkey, kind, CASE WHEN kind = '' THEN '' WHEN found = '' THEN 'risk reduction' ELSE found END AS categories FROM f""",
)
def solution_categories(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_KIND).alias("kind"))
    return rows.select("p_partkey", "kind", F.array_join(T.categories(F.col("kind")), "|").alias("categories"))


_VALUE = """CASE c_custkey % 12 WHEN 0 THEN concat(c_custkey % 120, '.5, ', c_custkey % 250) WHEN 1 THEN concat('-', c_custkey % 91, ',', c_nationkey) WHEN 2 THEN 'TRUE' WHEN 3 THEN concat(c_custkey % 3, '.0')
  WHEN 4 THEN '-0' WHEN 5 THEN concat(c_custkey, 'e', c_nationkey) WHEN 6 THEN concat('9223372036854775', 800 + c_nationkey) WHEN 7 THEN concat(c_custkey, '.00') WHEN 8 THEN concat(lower(substr(c_mktsegment, 1, 2)), '-GB')
  WHEN 9 THEN '' WHEN 10 THEN c_mktsegment ELSE concat(10 + c_nationkey, '-', c_custkey) END"""


@query(
    "typed_value_checks",
    rf"""WITH c AS (SELECT c_custkey, {_VALUE} AS v FROM customer), d AS (SELECT *, string_split(replace(v, ' ', ''), ',') AS parts, regexp_extract(trim(v), '^([+-]?\d+)(?:\.0*)?$', 1) AS whole FROM c)
    SELECT c_custkey, v AS value, coalesce(len(parts) = 2 AND abs(TRY_CAST(parts[1] AS DOUBLE)) <= 90 AND abs(TRY_CAST(parts[2] AS DOUBLE)) <= 180, false) AS geo_point,
      lower(v) IN ('true', '"true"', 'false', '"false"', '0', '1', '0.0', '1.0', '-0', '-0.0') AS boolean_value, regexp_matches(trim(v), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') AS double_value,
      whole <> '' AND TRY_CAST(whole AS BIGINT) IS NOT NULL AS long_value, regexp_matches(v, '^[a-zA-Z]{{1,8}}(-[a-zA-Z0-9]{{1,8}})*$') AS language FROM d""",
)
def typed_value_checks(spark, sf_dir):
    rows, v = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_VALUE).alias("value")), F.col("value")
    return rows.select(
        "c_custkey", "value", T.is_geo_point(v).alias("geo_point"), T.is_boolean(v).alias("boolean_value"), T.is_double(v).alias("double_value"),
        T.is_long(v).alias("long_value"), T.is_language_tag(v).alias("language"),
    )


_TYPE = """CASE o_orderkey % 5 WHEN 0 THEN 'http://www.w3.org/2001/XMLSchema#dateTime' WHEN 1 THEN concat('http://www.w3.org/2001/XMLSchema#long', o_orderstatus)
  WHEN 2 THEN concat('http://www.w3.org/2001/XMLSchema#', o_orderpriority) WHEN 3 THEN concat('http://x.org/', o_orderkey) ELSE o_orderpriority END"""


@query("datatype_tokens", rf"WITH o AS (SELECT o_orderkey, {_TYPE} AS uri FROM orders) SELECT o_orderkey, uri, coalesce(nullif(lower(regexp_extract(uri, 'XMLSchema#(\w+)$', 1)), ''), 'string') AS token FROM o")
def datatype_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TYPE).alias("uri"))
    return rows.select("o_orderkey", "uri", T.datatype_token(F.col("uri")).alias("token"))


_URI = """CASE p_partkey % 7 WHEN 0 THEN concat('sg:', p_brand) WHEN 1 THEN concat('sg:Early Warning(', concat('Manufacturer#', p_size), ')') WHEN 2 THEN p_type WHEN 3 THEN 'sg:()' WHEN 4 THEN concat('<http://x.org/', p_brand, '>')
  WHEN 5 THEN concat('kr:', p_type) ELSE p_name END"""


@query(
    "uri_labels",
    r"""WITH p AS (SELECT p_partkey, """ + _URI + r""" AS uri FROM part), q AS (SELECT *, CASE WHEN contains(uri, ':') THEN regexp_replace(uri, '^[^:]*:', '') ELSE uri END AS local,
      CASE WHEN contains(uri, ':') THEN split_part(uri, ':', 1) ELSE 'sg' END AS prefix FROM p)
    SELECT p_partkey, uri, trim(regexp_replace(string_split(uri, ':')[-1], '([A-Z])', ' \1', 'g')) AS label,
      CASE WHEN uri = '' THEN 'sg:Unknown' WHEN starts_with(uri, '<') AND ends_with(uri, '>') THEN uri
        ELSE prefix || ':' || coalesce(nullif(regexp_replace(local, '[^\p{L}\p{N}_-]', '', 'g'), ''), 'Unknown') END AS clean FROM q""",
)
def uri_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_URI).alias("uri"))
    return rows.select("p_partkey", "uri", T.camel_label(F.col("uri")).alias("label"), T.sanitise_uri(F.col("uri")).alias("clean"))


_FIELD = "CASE c_custkey % 3 WHEN 0 THEN 'countries' WHEN 1 THEN 'solution_category' ELSE 'solution_type' END"
_SLUG_OF = """CASE c_custkey % 3 WHEN 0 THEN CASE n_nationkey WHEN 0 THEN 'thailand' WHEN 1 THEN 'vietnam' WHEN 2 THEN 'sri lanka' ELSE lower(n_name) END WHEN 1 THEN CASE n_regionkey WHEN 0 THEN 'natural-catastrophe' WHEN 1 THEN 'cyber' WHEN 2 THEN 'health' ELSE lower(c_mktsegment) END
  ELSE CASE n_regionkey WHEN 3 THEN 'risk-financing' WHEN 4 THEN 'regulation' ELSE lower(n_name) END END"""
_LABELS = {f"field = '{field}' AND slug = '{old}'": f"'{new}'" for field, labels in C.FILTER_LABELS.items() for old, new in labels.items()}


@query(
    "filter_labels",
    f"""WITH c AS (SELECT c_custkey, {_FIELD} AS field, {_SLUG_OF} AS slug FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT c_custkey, field, slug, {_cases(_LABELS | {"field = 'countries'": "array_to_string(list_transform(string_split(slug, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"}, 'slug')} AS label FROM c""",
)
def filter_labels(spark, sf_dir):
    """Unknown slugs pass through; unknown countries are title-cased."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_nationkey", "n_name", "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_custkey", F.expr(_FIELD).alias("field"), F.expr(_SLUG_OF).alias("slug"))
    label = F.when(F.col("field") == "countries", F.initcap("slug")).otherwise(F.col("slug"))
    for field, labels in C.FILTER_LABELS.items():
        for old, new in labels.items():
            label = F.when((F.col("field") == field) & (F.col("slug") == old), new).otherwise(label)
    return rows.select("c_custkey", "field", "slug", label.alias("label"))


_SCOPES = "CASE r_regionkey WHEN 0 THEN 'BUILDING HOUSEHOLD' WHEN 1 THEN 'AUTOMOBILE' WHEN 2 THEN 'BUILDING AUTOMOBILE MACHINERY' WHEN 3 THEN '' ELSE 'MACHINERY FURNITURE' END"


@query(
    "ontology_routing",
    f"""WITH r AS (SELECT r_name AS ontology_id, r_regionkey AS priority, string_split({_SCOPES}, ' ') AS scopes FROM region),
    c AS (SELECT c_custkey, [c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END] AS asked FROM customer)
    SELECT c_custkey, ontology_id, priority, row_number() OVER (PARTITION BY c_custkey ORDER BY priority) AS nth FROM c JOIN r ON list_has_any(scopes, asked)""",
)
def ontology_routing(spark, sf_dir):
    """The ontologies whose scopes meet those asked for, in order of priority."""
    ontologies = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("ontology_id"), F.col("r_regionkey").alias("priority"), F.explode(F.split(F.expr(_SCOPES), " ")).alias("scope")
    )
    second = F.when(F.col("c_custkey") % 4 == 0, "HOUSEHOLD").otherwise("MACHINERY")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array_distinct(F.array("c_mktsegment", second))).alias("scope"))
    met = asked.join(ontologies, "scope").groupBy("c_custkey", "ontology_id", "priority").agg(F.count(F.lit(1)).alias("n"))
    routed = F.array_sort(F.collect_list(F.struct("priority", "ontology_id"))).alias("o")  # as many as there are ontologies at most
    rows = met.groupBy("c_custkey").agg(routed).select("c_custkey", F.posexplode("o").alias("at", "o"))
    return rows.select("c_custkey", "o.ontology_id", "o.priority", (F.col("at") + 1).cast("bigint").alias("nth"))


_TEXT = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN substr(p_name, 2, 4) ELSE concat(p_name, ' disaster') END"
_WHOLE = "CASE p_partkey % 4 WHEN 3 THEN split_part(p_name, ' ', 1) ELSE p_name END"


@query(
    "match_ladder",
    f"""WITH p AS (SELECT p_partkey, {_TEXT} AS text, {_WHOLE} AS concept FROM part)
    SELECT p_partkey, text, concept, CASE WHEN text = concept THEN 'exact' WHEN list_contains(string_split(concept, ' '), text) OR list_contains(string_split(text, ' '), concept) THEN 'partial' ELSE 'fuzzy' END AS kind,
      CAST(CASE WHEN text = concept THEN 1.0 WHEN list_contains(string_split(concept, ' '), text) OR list_contains(string_split(text, ' '), concept) THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence FROM p""",
)
def match_ladder(spark, sf_dir):
    """Exact, whole-word containment, then fuzzy."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_TEXT).alias("text"), F.expr(_WHOLE).alias("concept"))
    text, concept = F.col("text"), F.col("concept")
    kind = F.when(text == concept, "exact").when(T.whole_word(concept, text) | T.whole_word(text, concept), "partial").otherwise("fuzzy")
    score = F.when(kind == "exact", 1.0).when(kind == "partial", 0.8).otherwise(0.7)
    return rows.select("p_partkey", "text", "concept", kind.alias("kind"), score.alias("confidence"))


_SCRIPT = """concat('# orders of ', c_name, chr(10), 'PREFIX a: <http://x.org/', c_nationkey, '>', chr(10), 'INSERT DATA { a:', c_custkey, ' a:in a:', c_mktsegment, ' } ;', chr(10),
  'PREFIX c: <http://y.org/>', chr(10), 'DELETE { c:', c_custkey, ' c:phone "', concat(10 + c_nationkey, '-', c_custkey), '" }', chr(10))"""


@query(
    "script_requests",
    """WITH s AS (SELECT c_custkey, 'PREFIX a: <http://x.org/' || c_nationkey || '>' AS a, 'PREFIX c: <http://y.org/>' AS c, c_mktsegment, concat(10 + c_nationkey, '-', c_custkey) AS phone FROM customer)
    SELECT c_custkey, 0 AS n, a || chr(10) || 'INSERT DATA { a:' || c_custkey || ' a:in a:' || c_mktsegment || ' }' AS request FROM s
    UNION ALL SELECT c_custkey, 1, a || chr(10) || c || chr(10) || 'DELETE { c:' || c_custkey || ' c:phone "' || phone || '" }' FROM s""",
)
def script_requests(spark, sf_dir):
    """The requests of many scripts, each with the prefixes above it."""
    scripts = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SCRIPT).alias("script"))
    return I.script_requests(scripts, "c_custkey", "script")
