"""URL filters: host and path rules, and block decisions carried over to aliases.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._shared import connected_components, materialise

#: (verdict, host, path start)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased. Null or no ``://``: empty."""
    name = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(name, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end. Null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null; of equally
    long ones an allow wins. A rule fits its host and all subdomains if the path
    starts with the rule's."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(
            chosen
        )
    return chosen


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: the url without its fragment, scheme
    and host in lower case, an empty path as ``/``. Null without ``://``."""
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    root = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host(url), root, query))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, without quotes, entities and outer white space; missing: empty."""
    held = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s>\"']++)", 1)
    held = F.regexp_replace(held, "^[\"']|[\"']$", "")
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
        held = F.replace(held, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(held, r"[\t\r\n]", ""))


def resolved(base: Column, target: Column) -> Column:
    """The absolute url of a link target on the page base, with dot segments
    resolved; null for an empty target or one of a scheme without ``://``."""
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_after_scheme(base), r"^([^/?#]*)", 1))
    folder = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)), "[^/]*$", "")
    own, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    steps = F.aggregate(
        F.split(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)), "/"),
        F.array().cast("array<string>"),
        lambda kept, step: F.when(step == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept))
        .when(step == ".", kept).otherwise(F.concat(kept, F.array(step))),
    )
    walked = F.concat(F.array_join(steps, "/"), F.when(own.rlike(r"(^|/)\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))
    return (
        F.when((target == "") | (F.instr(base, "://") == 0), F.lit(None))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.instr(target, "://") > 0, target))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(site, path(base), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), target))
        .otherwise(F.concat(site, walked, rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) from a page's url to the target of its canonical link or meta
    refresh. Attribute order, quotes, further attributes of any length and further
    values of rel may vary; a relative target is resolved against the page's url
    (a base element is not read)."""
    tags = F.regexp_extract_all(
        "html", F.lit(r"(?is)(<(?:link|meta)\b(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>)"), F.lit(1)
    )
    hinted = pages.where(F.col("html").rlike(r"(?i)\b(canonical|refresh)\b")).select(
        F.col("url").alias("src"), F.explode(tags).alias("tag")
    )
    tag = F.col("tag")
    canonical = F.when(tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _attribute(tag, "href"))
    refresh = F.when(
        tag.rlike("(?i)^<meta") & _attribute(tag, "http-equiv").rlike("(?i)^refresh$"),
        F.regexp_extract(_attribute(tag, "content"), r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s]+)", 1),
    )
    found = hinted.select("src", F.coalesce(canonical, refresh).alias("target")).where("target is not null")
    return found.select("src", resolved(F.col("src"), F.col("target")).alias("dst")).where("dst is not null")


def judge(
    pages: DataFrame, links: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages.

    links(src, dst) are redirect or canonical edges between urls; None takes them
    from the pages' html. Urls connected over links are aliases, and so are urls
    that differ in fragment or in the case of scheme and host only. A page under a
    rule gets that rule's verdict, so an explicit allow stands whatever its
    aliases say; of equally long rules an allow wins. Any other page is blocked if
    one of its aliases is blocked by a rule, also an alias that is only the end of
    a link, and allowed otherwise.

    Null url, or none with ``://``: host and path are empty, no rule fits and the
    page has no alias. Null and empty html have no links; html of any length is
    read whole. Repeated rows each give a row; an empty table gives none; other
    columns are ignored.
    """
    edges = links.select("src", "dst") if links is not None else page_links(pages)
    edges = edges.select(alias_key(F.col("src")).alias("src"), alias_key(F.col("dst")).alias("dst"))
    edges = edges.where("src is not null and dst is not null and src != dst").select(
        F.md5("src").alias("u"), F.md5("dst").alias("v"), "src", "dst"
    )
    edges = materialise(edges.distinct())
    judged = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn(
        "hit", rule_of(F.col("host"), F.col("path"), rules)
    )
    answer = judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), "hit", "url")
    if edges.isEmpty():
        return answer.select(
            "page_id", "host", "path", "rule", F.coalesce("hit.verdict", F.lit("allow")).alias("verdict")
        )
    roots = connected_components(edges.select("u", "v"))
    ends = edges.select(F.col("u").alias("node"), F.col("src").alias("at")).union(edges.select("v", "dst")).distinct()
    blocked = materialise(
        ends.where(rule_of(host(F.col("at")), path(F.col("at")), rules)["verdict"] == "block")
        .join(roots, "node").select("root").distinct()
    )
    bad = materialise(roots.join(blocked, "root").select(F.col("node").alias("key"), F.lit(True).alias("bad")))
    return (
        answer.withColumn("key", F.md5(alias_key(F.col("url"))))
        .join(bad, "key", "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("hit.verdict", F.when(F.col("bad"), F.lit("block")), F.lit("allow")).alias("verdict"),
        )
    )
