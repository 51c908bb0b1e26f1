"""Queries over the scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import constants as C
from quarry.functions import text as T
from quarry.registry import query
from quarry.session import table

_NULLS = ", ".join(f"'{t}'" for t in C.NULL_TOKENS)
_STOP = ", ".join(f"'{t}'" for t in C.STOP_WORDS)
_TOK = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2)"
_SLUG = r"regexp_replace(trim(regexp_replace(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s-]', '', 'g')), '\s+', '_', 'g'), '_'), '_+', '_', 'g')"
_HASHED = r"concat_ws('_', nullif(substr(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]', '', 'g'), 1, 8), ''), substr(md5({0}), 1, 12))"


@query(
    "null_cleanup",
    f"""SELECT o_orderkey, CASE WHEN lower(trim(v)) IN ({_NULLS}) THEN '' ELSE trim(v) END AS cleaned
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' N/A ' WHEN 1 THEN 'None' WHEN 2 THEN '--' ELSE ' ' || o_orderpriority END AS v FROM orders)""",
)
def null_cleanup(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    value = F.when(kind == 0, " N/A ").when(kind == 1, "None").when(kind == 2, "--").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clean_null(value).alias("cleaned"))


@query(
    "document_ids",
    """SELECT page_id, substr(sha256(url), 1, 20) AS doc_id, 'sol_' || substr(sha256(url), 1, 17) AS solution_id,
    CASE WHEN page_id % 2 = 0 THEN 'sha256:' || sha256(html) ELSE 'md5:' || md5(html) END AS content_hash FROM pages""",
)
def document_ids(spark, sf_dir):
    etag = F.when(F.col("page_id") % 2 == 0, F.lit("abc-2")).otherwise(F.md5("html"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.document_id(F.col("url")).alias("doc_id"), T.solution_id(F.col("url")).alias("solution_id"),
        T.content_hash(etag, F.col("html")).alias("content_hash"),
    )


@query(
    "source_urls",
    r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'no link' ELSE 'see ' || url || ', or ' || url || '/more; end' END AS a, 'other ' || url || '?b c' AS b FROM pages),
    u AS (SELECT page_id, regexp_extract_all(a, 'https?://[^\s,;]+(?:\.[^\s,;]+)*') AS x, regexp_extract_all(b, 'https?://[^\s,;]+(?:\.[^\s,;]+)*') AS y FROM p)
    SELECT page_id, coalesce(x[1], y[1]) AS source_url, array_to_string(list_concat(x[2:], y), ' ') AS further FROM u""",
)
def source_urls(spark, sf_dir):
    url = F.col("url")
    first = F.when(F.col("page_id") % 3 == 0, "no link").otherwise(F.concat(F.lit("see "), url, F.lit(", or "), url, F.lit("/more; end")))
    second = F.concat(F.lit("other "), url, F.lit("?b c"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.source_url(first, second).alias("source_url"), F.array_join(T.further_urls(first, second), " ").alias("further")
    )


@query(
    "identifier_uris",
    r"""WITH p AS (SELECT p_partkey, p_name || ' #' || p_brand || '?(x)' AS t, p_type FROM part),
    c AS (SELECT *, trim(regexp_replace(regexp_replace(t, '[^\p{L}\p{N}_.\-]', '_', 'g'), '_+', '_', 'g'), '_') AS id,
          trim(regexp_replace(regexp_replace(p_type, '[^\p{L}\p{N}_.\-]', '_', 'g'), '_+', '_', 'g'), '_') AS kind FROM p)
    SELECT p_partkey, id AS identifier, 'kc:graph/' || kind || '/' || id AS graph_uri, 'kc:chunk/' || id || '/' || kind AS chunk_uri,
      'kc:mention/' || substr(md5(t || '#' || p_type || '#' || p_partkey), 1, 12) AS mention_uri,
      'kc:pair/' || substr(md5(t || '#' || least(id, kind) || '#' || greatest(id, kind)), 1, 12) AS pair_uri FROM c""",
)
def identifier_uris(spark, sf_dir):
    name = F.concat("p_name", F.lit(" #"), "p_brand", F.lit("?(x)"))
    identifier, kind = T.clean_identifier(name), T.clean_identifier(F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", identifier.alias("identifier"), T.graph_uri("kc:", F.col("p_type"), name).alias("graph_uri"),
        T.chunk_uri("kc:chunk/", name, F.col("p_type")).alias("chunk_uri"),
        T.mention_uri("kc:mention/", name, F.col("p_type"), F.col("p_partkey")).alias("mention_uri"),
        T.co_occurrence_uri("kc:pair/", name, kind, identifier).alias("pair_uri"),
    )


@query(
    "uri_checks",
    r"""SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1) ELSE split_part(url, '/', -1) END AS local_name,
    regexp_matches(url, '(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$') AS valid,
    length(url) >= 3 AND NOT regexp_matches(url, '[<>"\s]') AS clean_characters, starts_with(url, 'https://') AS secure,
    CASE WHEN starts_with(url, 'http://') THEN 'kc:' || substr(url, 8) ELSE url END AS rewritten, CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END AS slashed FROM pages""",
)
def uri_checks(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.local_name(url).alias("local_name"), T.is_valid_uri(url).alias("valid"),
        T.has_uri_characters(url).alias("clean_characters"), url.startswith("https://").alias("secure"),
        T.rewrite_namespace(url, "http://", "kc:").alias("rewritten"), T.with_slash(url).alias("slashed"),
    )


@query(
    "slugs",
    f"""WITH t AS (SELECT doc_id, split_part(text, chr(10), 1) AS s FROM documents)
    SELECT doc_id, {_SLUG.format('s')} AS slug, CASE WHEN length({_SLUG.format('s')}) > 50 OR {_SLUG.format('s')} = '' THEN {_HASHED.format('s')} ELSE {_SLUG.format('s')} END AS entity_slug,
    {_HASHED.format('s')} AS hashed_slug FROM t""",
)
def slugs(spark, sf_dir):
    first = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.slug(first).alias("slug"), T.entity_slug(first).alias("entity_slug"), T.hashed_slug(first).alias("hashed_slug")
    )


@query(
    "year_parse",
    r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') || ' and 07' WHEN 1 THEN 'from ' || strftime(o_orderdate, '%y') || ' to ' || strftime(o_orderdate, '%Y')
      WHEN 2 THEN '12, 30 and 99' WHEN 3 THEN 'no year' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders),
    y AS (SELECT o_orderkey, regexp_extract_all(s, '\b((?:19|20)\d{2})\b', 1) AS l, regexp_extract_all(s, '\b(\d{2})\b', 1) AS h FROM t)
    SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(l, list_transform(list_filter(h, lambda x: CAST(x AS INT) >= 10 AND NOT list_contains(list_transform(l, lambda z: contains(z, x)), true)),
      lambda x: CASE WHEN CAST(x AS INT) > 25 THEN '19' || x ELSE '20' || x END)))), ' ') AS years FROM y""",
)
def year_parse(spark, sf_dir):
    kind, date = F.col("o_orderkey") % 5, F.col("o_orderdate")
    four, two = F.date_format(date, "yyyy"), F.date_format(date, "yy")
    text = (
        F.when(kind == 0, F.concat(four, F.lit(" and 07"))).when(kind == 1, F.concat(F.lit("from "), two, F.lit(" to "), four))
        .when(kind == 2, "12, 30 and 99").when(kind == 3, "no year").otherwise(F.date_format(date, "yyyy-MM-dd"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.years(text), " ").alias("years"))


@query(
    "record_format",
    r"""WITH p AS (SELECT p_partkey, p_type || ', ' || p_brand || chr(10) || ' ,' || p_name AS kinds, p_size, p_name FROM part),
    q AS (SELECT *, lower(kinds) AS low, list_filter(list_transform(string_split_regex(kinds, '[,\n]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM p),
    c AS (SELECT *, list_filter([CASE WHEN contains(low, 'brushed') THEN 'brushed' END, CASE WHEN contains(low, 'steel') THEN 'steel' END], lambda x: x IS NOT NULL) AS hits FROM q)
    SELECT p_partkey, array_to_string(parts, '|') AS parts, CASE WHEN p_size > 25 THEN 'yes' ELSE 'unknown' END AS implemented,
      CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS ppp, CASE WHEN p_size < 10 THEN NULL ELSE (1990 + p_size) || '-01-01' END AS publication_date FROM c""",
)
def record_format(spark, sf_dir):
    kinds = F.concat("p_type", F.lit(", "), "p_brand", F.lit("\n ,"), "p_name")
    ppp = F.when(F.col("p_size") > 25, "Yes").otherwise("No")
    year = F.when(F.col("p_size") < 10, "soon").otherwise((F.col("p_size") + 1990).cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(T.split_list(kinds), "|").alias("parts"),
        F.when(ppp == "Yes", "yes").otherwise("unknown").alias("implemented"), F.when(ppp == "Yes", "yes").otherwise("no").alias("ppp"),
        T.year_date(year).alias("publication_date"),
    )


@query(
    "snippets",
    r"""SELECT doc_id, CASE WHEN length(trim(split_part(text, '.', 1), chr(10) || ' ')) > 20 THEN trim(split_part(text, '.', 1), chr(10) || ' ') || '.' END AS highlight,
    CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet,
    CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS abstract, substr(text, 1, 500) AS preview FROM documents""",
)
def snippets(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.highlight(text).alias("highlight"), T.ellipsis(text, 200).alias("snippet"), T.ellipsis(text, 500).alias("abstract"),
        F.substring(text, 1, 500).alias("preview"),
    )


@query(
    "query_processing",
    f"""WITH q AS (SELECT conv_id, turn, trim(substr(trim(regexp_replace(CASE WHEN turn % 3 = 0 THEN ' to  be in the ' ELSE text END, '\\s+', ' ', 'g')), 1, 500)) AS cleaned FROM conversations)
    SELECT conv_id, turn, cleaned, len({_TOK.format('cleaned')}) AS n_tokens,
    CASE WHEN len(list_filter({_TOK.format('cleaned')}, lambda x: NOT list_contains([{_STOP}], x))) > 0 THEN 'hybrid_full' ELSE 'filter_only' END AS strategy FROM q""",
)
def query_processing(spark, sf_dir):
    cleaned = T.clean_query(F.when(F.col("turn") % 3 == 0, " to  be in the ").otherwise(F.col("text")))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", cleaned.alias("cleaned"), F.size(T.tokens(cleaned)).alias("n_tokens"), T.strategy(cleaned).alias("strategy")
    )


@query(
    "literal_escapes",
    r"""WITH t AS (SELECT doc_id, text || chr(9) || '"q"\' || chr(13) || '''' AS s FROM documents)
    SELECT doc_id, substr(regexp_replace(replace(replace(replace(replace(replace(s, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), ''), chr(9), ' '), '[\x00-\x1F]', '', 'g'), 1, 200) AS literal,
    replace(replace(replace(replace(replace(s, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS turtle,
    replace(replace(replace(replace(replace(replace(s, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '''', '\''') AS sparql FROM t""",
)
def literal_escapes(spark, sf_dir):
    text = F.concat("text", F.lit('\t"q"\\\r\''))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.escape_literal(text).alias("literal"), T.escape_turtle(text).alias("turtle"), T.escape_sparql(text).alias("sparql")
    )


@query(
    "pseudo_documents",
    r"""WITH p AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS kind, p_size, replace(p_type, ' ', ', ') AS themes,
      string_split(p_type, ' ') AS l FROM part),
    o AS (SELECT *, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l)-1], ', ') || ', and ' || l[len(l)] END AS listed FROM p),
    i AS (SELECT *, concat_ws(' ', p_name, 'is a solution', 'from ' || p_brand, CASE WHEN kind <> '' THEN 'addressing ' || kind END, 'implemented in ' || p_size, 'with themes of ' || listed) || '.' AS intro FROM o)
    SELECT p_partkey, intro, concat_ws(chr(10) || chr(10), p_name, 'Introduction', intro, CASE WHEN kind <> '' THEN 'Description' || chr(10) || chr(10) || kind END, 'Key Highlights' || chr(10) || chr(10) || p_brand) AS document,
    concat_ws(' ', nullif(p_name, ''), nullif(kind, ''), nullif(p_brand, '')) AS full_text FROM i""",
)
def pseudo_documents(spark, sf_dir):
    kind = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    themes = F.replace("p_type", F.lit(" "), F.lit(", "))
    intro = T.introduction(F.col("p_name"), F.col("p_brand"), kind, F.col("p_size").cast("string"), themes)
    return table(spark, sf_dir, "part").select(
        "p_partkey", intro.alias("intro"),
        T.pseudo_document(F.col("p_name"), intro, description=kind, key_highlights=F.col("p_brand")).alias("document"),
        T.full_text(F.col("p_name"), kind, F.col("p_brand")).alias("full_text"),
    )


@query(
    "match_normalisation",
    r"""SELECT doc_id, regexp_replace(regexp_replace(lower(trim(s, chr(10) || ' ')), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s-]', '', 'g') AS matched,
    trim(regexp_replace(replace(replace(s, '–', '-'), '’', ''''), '\s+', ' ', 'g')) AS ocr FROM (SELECT doc_id, text || ' – it’s' AS s FROM documents)""",
)
def match_normalisation(spark, sf_dir):
    text = F.concat("text", F.lit(" – it’s"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.normalise_for_match(text).alias("matched"), T.normalise_ocr(text).alias("ocr")
    )


@query(
    "storage_urls",
    """SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN 'bucket-' || p_size END AS bucket, CASE WHEN p_size % 4 <> 0 THEN 'data/' || p_partkey || '.json' END AS key FROM part""",
)
def storage_urls(spark, sf_dir):
    scheme = F.when(F.col("p_size") % 4 == 0, "http://").otherwise("s3://")
    url = F.concat(scheme, F.lit("bucket-"), "p_size", F.lit("/data/"), "p_partkey", F.lit(".json"))
    return table(spark, sf_dir, "part").select("p_partkey", T.object_bucket(url).alias("bucket"), T.object_key(url).alias("key"))


@query(
    "provider_costs",
    """WITH c AS (SELECT doc_id, greatest(1.0, n_chars / 100) * 0.0002 + 2.0 * 1024 / 1024 * 0.0000166667 AS managed, (3.0 + n_chars / 1000 * 0.5) * (3008 / 1024) * 0.0000166667 AS local FROM documents)
    SELECT doc_id, round(managed, 8) AS managed, round(local, 8) AS local, CASE WHEN managed >= local AND abs(managed - local) / greatest(managed, local) * 100 > 30 THEN 'local' ELSE 'managed' END AS recommended FROM c""",
)
def provider_costs(spark, sf_dir):
    size = F.col("n_chars").cast("double")
    managed, local = T.managed_cost(size), T.local_cost(size)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(managed, 8).alias("managed"), F.round(local, 8).alias("local"), T.recommended(managed, local).alias("recommended")
    )


@query(
    "break_even",
    """WITH l AS (SELECT lang, CAST(round(avg(n_chars)) AS DOUBLE) AS size FROM documents GROUP BY lang), v(volume) AS (VALUES (10), (50), (100), (500), (1000), (5000), (10000)),
    c AS (SELECT lang, volume, volume * (greatest(1.0, size / 100) * 0.0002 + 2.0 * 0.0000166667) AS m, volume * ((3.0 + size / 1000 * 0.5) * 2.9375 * 0.0000166667) AS o FROM l, v)
    SELECT lang, min(CASE WHEN o <= m THEN volume END) AS break_even, round(sum(m), 4) AS managed_total, round(sum(o), 4) AS local_total FROM c GROUP BY lang""",
)
def break_even(spark, sf_dir):
    """The smallest of seven volumes at which the local provider is no dearer."""
    sizes = table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg("n_chars")).alias("size"))
    rows = sizes.select("lang", "size", F.explode(F.array(*map(F.lit, C.BREAK_EVEN_VOLUMES))).alias("volume"))
    m, o = F.col("volume") * T.managed_cost(F.col("size")), F.col("volume") * T.local_cost(F.col("size"))
    return rows.groupBy("lang").agg(
        F.min(F.when(o <= m, F.col("volume"))).alias("break_even"), F.round(F.sum(m), 4).alias("managed_total"), F.round(F.sum(o), 4).alias("local_total")
    )


@query(
    "json_keys",
    """SELECT event_id, TRY_CAST(json_extract_string(regexp_extract('noise ' || props || ' tail', '(\\{.*\\})', 1), '$.k') AS INT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS has_key, json_extract_string(props, '$.z') IS NOT NULL AS has_other FROM events""",
)
def json_keys(spark, sf_dir):
    text = T.json_object(F.concat(F.lit("noise "), "props", F.lit(" tail")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object(text, "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_key"),
        F.get_json_object("props", "$.z").isNotNull().alias("has_other"),
    )


@query(
    "chunk_ids",
    """SELECT doc_id, 'd' || doc_id AS of_doc, CAST(doc_id % 100 AS INT) AS sequence, 0 AS no_sequence FROM documents""",
)
def chunk_ids(spark, sf_dir):
    chunk = F.concat(F.lit("d"), "doc_id", F.lit("_chunk_"), F.lpad((F.col("doc_id") % 100).cast("string"), 4, "0"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.doc_of_chunk(chunk).alias("of_doc"), T.sequence_of_chunk(chunk).alias("sequence"),
        T.sequence_of_chunk(F.col("source")).alias("no_sequence"),
    )


@query(
    "interval_predicates",
    """SELECT o_orderkey, l_linenumber, CAST(epoch(l_shipdate - o_orderdate) AS BIGINT) AS seconds, l_shipdate > o_orderdate + INTERVAL 60 DAY AS late,
    CAST(o_orderdate AS DATE) = DATE '1995-03-15' AS on_day, o_orderpriority LIKE '1-%' AS urgent, o_orderpriority LIKE '%HIGH%' AS high
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def interval_predicates(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    seconds = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate"))
    return rows.select(
        "o_orderkey", "l_linenumber", seconds.alias("seconds"), (F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("late"),
        (F.to_date("o_orderdate") == F.lit("1995-03-15").cast("date")).alias("on_day"), F.col("o_orderpriority").like("1-%").alias("urgent"),
        F.col("o_orderpriority").like("%HIGH%").alias("high"),
    )


@query(
    "keyword_predicates",
    "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{t}')" for t in C.CLIMATE_TERMS) + " AS climate, ("
    + " OR ".join(f"contains(lower(text), '{t}')" for t in C.HAZARD_TERMS) + ") AND (" + " OR ".join(f"contains(lower(text), '{t}')" for t in C.REMEDY_TERMS) + ") AS both_lists FROM documents",
)
def keyword_predicates(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.contains_any(low, C.CLIMATE_TERMS).alias("climate"),
        (T.contains_any(low, C.HAZARD_TERMS) & T.contains_any(low, C.REMEDY_TERMS)).alias("both_lists"),
    )
