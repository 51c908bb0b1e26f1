"""The registered queries opN_<name> of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import alignment, chat, decontaminate, embed_dedup, langid, merkle, mixing, packing, simhash, substring_dedup, token_counts, url_filter, warc
from quarry.llm._shared import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(chats.unionByName(planted)))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_copies(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r(verdict, name, start) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
)
SELECT page_id, host, path,
       (SELECT arg_max(name || start, length(name || start)) FROM r
        WHERE (q.host = r.name OR ends_with(q.host, '.' || r.name)) AND starts_with(q.path, r.start)) AS rule,
       coalesce((SELECT arg_max(verdict, length(name || start)) FROM r
        WHERE (q.host = r.name OR ends_with(q.host, '.' || r.name)) AND starts_with(q.path, r.start)), 'allow') AS verdict
FROM q
"""

OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)
), f AS (SELECT win, min(doc_id) AS owner FROM v GROUP BY win),
g AS (
  SELECT DISTINCT doc_id, i + k AS i FROM v JOIN f USING (win), range(50) r(k) WHERE f.owner < v.doc_id
), u AS (
  SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN g USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""

OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.r <> b.r AND array_cosine_similarity(a.v, b.v) >= 0.9
), c(u, w) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT c.u, l.v FROM c JOIN l ON l.u = c.w
), m AS (SELECT u, min(w) AS component_id FROM c GROUP BY u),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.u = vec_id LEFT JOIN n ON n.u = vec_id
"""

OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]|\[SEP\]', '.\0', 'g')) AS n,
         length(regexp_replace(replace(role, '\', '\\'), '<s>|</s>|\[INST\]|\[/INST\]|\[SEP\]', '.\0', 'g')) AS r FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(CASE WHEN role = 'assistant' THEN n + 4 ELSE n + r + 18 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, html FROM p),
b AS (
  SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS INT) >> (15 - 5 * (k % 4))) & 31), 1), '' ORDER BY k)
            FROM range(32) r(k)) AS payload_digest,
         max(page_id) OVER (PARTITION BY html) AS top FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""

OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT *, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, c: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda k, z: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END, xor(crc, c)), 4294967295::BIGINT) & 1 = 1 AS even
  FROM documents
), f AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other FROM t
), d AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS copied FROM f
), e AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d
), a(source, lev, idx, h, n) AS (
  SELECT source, 0, i, leaf, n FROM e
  UNION ALL
  SELECT source, lev + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM a WHERE n > 1 GROUP BY source, lev, idx // 3, n
), s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS j, count(*) OVER () AS n FROM a WHERE n = 1
), b(lev, idx, h, n) AS (
  SELECT 0, j, subroot, n FROM s
  UNION ALL
  SELECT lev + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM b WHERE n > 1 GROUP BY lev, idx // 3, n
), r AS (
  SELECT e.source, i, lev, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < i // CAST(pow(3, lev) AS BIGINT)), '') || '|'
    || coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > i // CAST(pow(3, lev) AS BIGINT)), '') AS run
  FROM e JOIN a ON e.source IS NOT DISTINCT FROM a.source AND a.n > 1 AND a.idx // 3 = i // CAST(pow(3, lev + 1) AS BIGINT) GROUP BY ALL
), q AS (
  SELECT source, j, lev, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < j // CAST(pow(3, lev) AS BIGINT)), '') || '|'
    || coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > j // CAST(pow(3, lev) AS BIGINT)), '') AS run
  FROM s JOIN b ON b.n > 1 AND b.idx // 3 = j // CAST(pow(3, lev + 1) AS BIGINT) GROUP BY ALL
), rp AS (SELECT source, i, list(run ORDER BY lev) AS path FROM r GROUP BY ALL),
qp AS (SELECT source, list(run ORDER BY lev) AS path FROM q GROUP BY ALL),
p AS (
  SELECT e.*, s.subroot, list_concat(coalesce(rp.path, []), coalesce(qp.path, [])) AS path
  FROM e JOIN s ON s.source IS NOT DISTINCT FROM e.source LEFT JOIN rp ON rp.source IS NOT DISTINCT FROM e.source AND rp.i = e.i
  LEFT JOIN qp ON qp.source IS NOT DISTINCT FROM e.source
), z AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
    list_reduce(path, lambda h, run: sha256(split_part(run, '|', 1) || h || split_part(run, '|', 2)), copied) AS folded_root FROM p
)
SELECT *, folded_root = root AS verified FROM z
"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_url_filters": op8_url_filters,
    "op9_warc": op9_warc,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_mixing": op11_mixing,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL = {
    "op9_warc": OP9_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op8_url_filters": OP8_SQL,
    "op13_merkle": OP13_SQL,
}
