"""Scalar text functions as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import constants as C

#: Word characters as Unicode has them; \w is ASCII-only in both SQL engines.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_\s-]"


def _any(texts, make) -> Column:
    return reduce(lambda a, b: a | b, [make(t) for t in texts])


def contains_any(text: Column, terms) -> Column:
    return _any(terms, lambda t: text.contains(t))


def clean_null(value: Column) -> Column:
    """Trimmed, with null and null-like tokens as the empty string."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(F.lower(trimmed).isin(*C.NULL_TOKENS), "").otherwise(trimmed)


URL = r"https?://[^\s,;]+(?:\.[^\s,;]+)*"


def all_urls(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({URL})"), F.lit(1))


def source_url(first: Column, second: Column) -> Column:
    """The first url of the first text, else of the second, else null."""
    return F.coalesce(F.get(all_urls(first), F.lit(0)), F.get(all_urls(second), F.lit(0)))


def further_urls(first: Column, second: Column) -> Column:
    """All urls but the first of the first text, then those of the second."""
    return F.concat(F.slice(all_urls(first), 2, 10_000), all_urls(second))


def document_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 20)


def solution_id(url: Column) -> Column:
    return F.concat(F.lit("sol_"), F.substring(F.sha2(url, 256), 1, 17))


def content_hash(etag: Column, content: Column) -> Column:
    """A multipart etag (with a hyphen) hashes the content, any other is an MD5."""
    return F.when(etag.contains("-"), F.concat(F.lit("sha256:"), F.sha2(content, 256))).otherwise(
        F.concat(F.lit("md5:"), etag)
    )


def clean_identifier(text: Column) -> Column:
    """Everything but word characters, hyphens and dots becomes one underscore."""
    flat = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_.\-]", "_"), "_+", "_")
    trimmed = F.regexp_replace(flat, "^_+|_+$", "")
    return F.regexp_replace(F.url_encode(trimmed), r"\+", "%20")


def mention_uri(base: str, chunk: Column, concept: Column, position: Column) -> Column:
    return F.concat(F.lit(base), F.substring(F.md5(F.concat_ws("#", chunk, concept, position.cast("string"))), 1, 12))


def co_occurrence_uri(base: str, chunk: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit(base), F.substring(F.md5(F.concat_ws("#", chunk, F.least(a, b), F.greatest(a, b))), 1, 12))


def graph_uri(base: str, kind: Column, name: Column) -> Column:
    return F.concat(F.lit(f"{base}graph/"), clean_identifier(kind), F.lit("/"), clean_identifier(name))


def chunk_uri(base: str, doc: Column, chunk: Column) -> Column:
    return F.concat(F.lit(base), clean_identifier(doc), F.lit("/"), clean_identifier(chunk))


def local_name(uri: Column) -> Column:
    """After the last #, else after the last /."""
    return F.when(uri.contains("#"), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


VALID_URI = (
    r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?(?:/?|[/?]\S+)$"
)


def is_valid_uri(uri: Column) -> Column:
    return uri.rlike(VALID_URI)


def has_uri_characters(uri: Column) -> Column:
    return F.coalesce((F.length(uri) >= 3) & ~uri.rlike(r"[<>\"\s]"), F.lit(False))


def slug(text: Column) -> Column:
    """Lower case, no punctuation but hyphens, white space as one underscore."""
    bare = F.regexp_replace(F.lower(text), NOT_WORD, "")
    spaced = F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(spaced, "_+", "_"), "^_+|_+$", "")


def hashed_slug(text: Column) -> Column:
    """Up to eight readable characters and twelve of the MD5."""
    code = F.substring(F.md5(text), 1, 12)
    readable = F.substring(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", ""), 1, 8)
    return F.when(readable != "", F.concat_ws("_", readable, code)).otherwise(code)


def entity_slug(text: Column) -> Column:
    plain = slug(text)
    return F.when((F.length(plain) > 50) | (plain == ""), hashed_slug(text)).otherwise(plain)


def strip_titles(name: Column) -> Column:
    found = F.trim(name)
    for title in C.TITLES:
        escaped = title.replace(".", r"\.")
        found = F.regexp_replace(found, rf"(?i)\b{escaped}\.?\s+", "")
    return found


def person_slug(name: Column) -> Column:
    return entity_slug(strip_titles(name))


def organisation_slug(name: Column) -> Column:
    low = F.lower(F.trim(name))
    known = F.when(F.lit(False), F.lit(""))
    for full, short in C.ORG_ABBREVIATIONS.items():
        known = known.when(low.isin(full.lower(), short), short)
    return known.otherwise(entity_slug(F.trim(name)))


def mint_uri(kind: Column, text: Column, prefix: str = "kr:") -> Column:
    """A typed uri of an entity."""
    typed = (
        F.when(kind == "PERSON", F.concat(F.lit("person/"), person_slug(text)))
        .when(kind == "ORGANIZATION", F.concat(F.lit("organization/"), organisation_slug(text)))
        .when(kind.isin("LOCATION", "DATE", "CONCEPT"), F.concat_ws("/", F.lower(kind), entity_slug(text)))
        .when(kind == "QUANTITY", F.concat(F.lit("quantity/"), hashed_slug(text)))
        .otherwise(F.concat_ws("/", F.replace(F.lower(kind), F.lit("_"), F.lit("")), entity_slug(text)))
    )
    return F.concat(F.lit(prefix), typed)


def expand_curie(curie: Column) -> Column:
    prefix, rest = F.substring_index(curie, ":", 1), F.regexp_replace(curie, "^[^:]*:", "")
    full = F.when(F.lit(False), F.lit(""))
    for name, space in C.PREFIXES.items():
        full = full.when((prefix == name) & curie.contains(":"), F.concat(F.lit(space), rest))
    return full.otherwise(curie)


def years(text: Column) -> Column:
    """Sorted distinct years: four digits from 19xx and 20xx, and lone two-digit
    numbers from 10 that are part of no such year; over 25 means the 1900s."""
    long = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    short = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(\d{2})\b"), F.lit(1))
    fresh = F.filter(short, lambda s: ~F.exists(long, lambda y: y.contains(s)) & (s.cast("int") >= 10))
    full = F.transform(fresh, lambda s: F.concat(F.when(s.cast("int") > 25, "19").otherwise("20"), s))
    return F.array_sort(F.array_distinct(F.concat(long, full)))


def year_date(text: Column) -> Column:
    return F.concat(F.try_to_number(F.trim(text), F.lit("9999")).cast("int").cast("string"), F.lit("-01-01"))


def split_list(text: Column) -> Column:
    """Parts between commas and line breaks, trimmed, none empty."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[,\n]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def categories(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(contains_any(low, t), F.lit(c)) for c, t in C.CATEGORY_TERMS.items()]))
    default = F.array(F.lit("risk reduction"))
    return F.when(low == "", F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(default)


def highlight(text: Column) -> Column:
    """The first sentence if it is over 20 characters, else null."""
    first = F.regexp_replace(F.get(F.split(text, r"\."), F.lit(0)), r"^\s+|\s+$", "")
    return F.when(F.length(first) > 20, F.concat(first, F.lit(".")))


def ellipsis(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def clean_query(text: Column, most: int = 500) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.trim(F.substring(flat, 1, most))


def tokens(text: Column, shortest: int = 2) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD}+)"), F.lit(1))
    return F.filter(found, lambda t: F.length(t) >= shortest)


def strategy(query: Column) -> Column:
    """hybrid_full if the query has a token that is no stop word, else filter_only."""
    words = F.array_except(tokens(query), F.array(*map(F.lit, C.STOP_WORDS)))
    return F.when(F.size(words) > 0, "hybrid_full").otherwise("filter_only")


def normalise_concept(text: Column) -> Column:
    """The canonical form of a concept; null if it runs several together."""
    trimmed = F.trim(text)
    flat = F.regexp_replace(trimmed, r"\s+", " ")
    mapped = F.when(contains_any(trimmed, C.MALFORMED_CONCEPT), F.lit(None).cast("string"))
    for old, new in C.CONCEPT_RULES.items():
        mapped = mapped.when(trimmed == old, new)
    return mapped.when(flat.endswith("ed Penetration"), F.replace(flat, F.lit("ed Penetration"), F.lit("e Penetration"))).otherwise(flat)


def clean_organisation(name: Column) -> Column:
    flat = F.regexp_replace(F.trim(name), r"\s+", " ")
    bare = F.regexp_replace(flat, "^[.,;]+|[.,;]+$", "")
    return F.when(F.upper(F.trim(name)).isin("NIL", "N/A", "NULL", ""), None).otherwise(F.nullif(bare, F.lit("")))


def needs_country(name: Column) -> Column:
    return contains_any(F.lower(name), C.GENERIC_ORG_WORDS)


_BASE_COUNTRY = r"^(.+?)\s*\(([^)]+)\)$"


def base_name(name: Column) -> Column:
    found = F.regexp_extract(name, _BASE_COUNTRY, 1)
    return F.when(found == "", name).otherwise(F.trim(found))


def country_of(name: Column) -> Column:
    return F.trim(F.regexp_extract(name, _BASE_COUNTRY, 2))


def normalise_organisation(name: Column) -> Column:
    found = F.trim(name)
    for pattern, new in C.ORG_RULES:
        found = F.regexp_replace(found, f"(?i){pattern}", new)
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def organisation_type(name: Column) -> Column:
    low = F.lower(name)
    found = F.when(F.lit(False), F.lit(""))
    for kind, words in C.ORG_TYPES.items():
        found = found.when(contains_any(low, words), kind)
    return found.otherwise("unknown")


def organisation_class(name: Column, kind: Column) -> Column:
    base = F.lower(F.regexp_replace(name, r"\s*\([^)]+\)\s*$", ""))
    found = F.when(F.lit(False), F.lit(""))
    for label, patterns in C.ORG_CLASSES.items():
        found = found.when(base.rlike("|".join(patterns)), label)
    for given, label in C.ORG_FALLBACK.items():
        found = found.when(kind == given, label)
    return found.otherwise("org:Organization")


def organisation_uri(name: Column) -> Column:
    country = country_of(name)
    return F.concat(F.lit("sg:Org_"), slug(base_name(name)), F.when(country != "", F.concat(F.lit("_"), slug(country))).otherwise(""))


def camel_label(uri: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(uri, ":", -1), "([A-Z])", " $1"))


def sanitise_uri(uri: Column) -> Column:
    local = F.when(uri.contains(":"), F.regexp_replace(uri, "^[^:]*:", "")).otherwise(uri)
    prefix = F.when(uri.contains(":"), F.substring_index(uri, ":", 1)).otherwise("sg")
    kept = F.regexp_replace(local, r"[^\p{L}\p{N}_-]", "")
    return (
        F.when(F.coalesce(uri, F.lit("")) == "", "sg:Unknown")
        .when(uri.startswith("<") & uri.endswith(">"), uri)
        .otherwise(F.concat_ws(":", prefix, F.when(kept == "", "Unknown").otherwise(kept)))
    )


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_literal(text: Column, most: int = 200) -> Column:
    found = _replaced(F.coalesce(text, F.lit("")), ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", ""), ("\t", " "))
    return F.substring(F.regexp_replace(found, r"[\x00-\x1F]", ""), 1, most)


def escape_turtle(text: Column) -> Column:
    return _replaced(text, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escape_sparql(text: Column) -> Column:
    return F.replace(escape_turtle(text), F.lit("'"), F.lit("\\'"))


def full_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])


def oxford_list(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.try_element_at(items, F.lit(-1))
    return (
        F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat_ws(" and ", head, last))
        .otherwise(F.concat(head, F.lit(", and "), last))
    )


def introduction(name: Column, country: Column, kind: Column, year: Column, themes: Column) -> Column:
    """One sentence about a record, of the parts that are there."""
    part = lambda lead, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(lead), value))
    return F.concat(
        F.concat_ws(
            " ", part("", name), F.lit("is a solution"), part("from ", country), part("addressing ", kind),
            part("implemented in ", year), part("with themes of ", oxford_list(split_list(themes))),
        ),
        F.lit("."),
    )


def pseudo_document(title: Column, intro: Column, **sections: Column) -> Column:
    """Titled sections parted by blank lines; empty ones are left out."""
    parts = [title, F.lit("Introduction"), intro]
    for name, text in sections.items():
        shown = F.lit(name.replace("_", " ").title())
        parts += [F.when(F.coalesce(text, F.lit("")) != "", F.concat_ws("\n\n", shown, text))]
    return F.concat_ws("\n\n", *parts)


def normalise_for_match(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+", " ")
    return F.regexp_replace(flat, NOT_WORD, "")


def normalise_ocr(text: Column) -> Column:
    """Straight quotes and hyphens, no soft hyphens, ligatures apart, single spaces."""
    plain = F.translate(text, "‘’“”–—", "''\"\"--")
    plain = _replaced(plain, ("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl"))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def datatype_token(uri: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(uri, r"XMLSchema#(\w+)$", 1)), F.lit("")), F.lit("string"))


def is_geo_point(text: Column) -> Column:
    parts = F.split(F.replace(text, F.lit(" "), F.lit("")), ",")
    lat, lon = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.coalesce((F.size(parts) == 2) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def is_boolean(text: Column) -> Column:
    return F.lower(text).isin("true", '"true"', "false", '"false"', "0", "1", "0.0", "1.0", "-0", "-0.0")


def is_double(text: Column) -> Column:
    return F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def is_long(text: Column) -> Column:
    whole = F.regexp_extract(F.trim(text), r"^([+-]?\d+)(?:\.0*)?$", 1)
    return (whole != "") & whole.try_cast("bigint").isNotNull()


def is_language_tag(text: Column) -> Column:
    return text.rlike(r"^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$")


def rewrite_namespace(iri: Column, old: str, new: str) -> Column:
    return F.when(iri.startswith(old), F.concat(F.lit(new), F.substring(iri, len(old) + 1, 1 << 20))).otherwise(iri)


def with_slash(iri: Column) -> Column:
    return F.when(iri.endswith("/"), iri).otherwise(F.concat(iri, F.lit("/")))


def object_bucket(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^s3://([^/]+)/(.+)$", 1), F.lit(""))


def object_key(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^s3://([^/]+)/(.+)$", 2), F.lit(""))


def managed_cost(size: Column) -> Column:
    """Per document: units of 100 characters, one at least, and compute seconds."""
    units = F.greatest(F.lit(1.0), size / 100)
    return units * C.COSTS["api_unit"] + C.COSTS["managed_seconds"] * C.COSTS["managed_mb"] / 1024 * C.COSTS["gb_second"]


def local_cost(size: Column) -> Column:
    seconds = F.lit(C.COSTS["local_base_seconds"]) + size / 1000 * C.COSTS["local_seconds_per_1k"]
    return seconds * (C.COSTS["local_mb"] / 1024) * C.COSTS["gb_second"]


def recommended(managed: Column, local: Column) -> Column:
    """The cheaper provider; the local one only if it saves over 30 percent."""
    saved = F.abs(managed - local) / F.greatest(managed, local) * 100
    return F.when((managed >= local) & (saved > 30), "local").otherwise("managed")


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def doc_of_chunk(chunk: Column) -> Column:
    return F.substring_index(chunk, "_chunk_", 1)


def sequence_of_chunk(chunk: Column) -> Column:
    return F.coalesce(F.regexp_extract(chunk, r"_chunk_(\d+)$", 1).try_cast("int"), F.lit(0))


def whole_word(text: Column, word: Column) -> Column:
    return F.array_contains(F.split(text, " "), word)
