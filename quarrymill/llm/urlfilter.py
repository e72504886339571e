"""URL filters by rules and redirect equivalence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import connected_components, discard, materialize

#: (action, host, start of the path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Tags in which a page names its canonical address or sends the visitor on.
CANONICAL = r"(?i)<link\s[^>]*rel\s*=\s*[\"']?canonical[^>]*>"
REFRESH = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>"
HREF = r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"
GOES_TO = r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)"


def rest_of(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address without scheme, leading www., closing slashes, fragment and tracking parameters; null without ://."""
    query = F.regexp_extract(rest_of(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(TRACKING) & (p != "")), "&")
    base = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.when(kept == "", base).otherwise(F.concat(base, F.lit("?"), kept)))


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a parent domain of it and the path's start; else null.

    Rules are a list of the caller's, tried from the longest; of equal lengths allow comes first.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for action, rule_host, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1:])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(action).alias("verdict"))).otherwise(found)
    return found


def resolved(target: Column, url: Column) -> Column:
    """target as an address: as it is with a scheme; else against the page's url, as browsers do for //host, /path, ?query
    and relative paths (without folding ..); null for fragments, other schemes and pages without an address."""
    at = F.instr(url, "://")
    scheme = F.when(at > 0, F.substr(url, F.lit(1), at - 1))
    host = F.regexp_extract(rest_of(url), r"^[^/?#]*", 0)
    path = path_of(url)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    base = F.concat(scheme, F.lit("://"), host)
    relative = F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(base, target)).when(target.startswith("?"), F.concat(base, path, target)).otherwise(F.concat(base, folder, F.regexp_replace(target, r"^(\./)+", "")))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target).when((target != "") & ~target.startswith("#") & ~target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), relative)


def targets_of(html: Column, url: Column) -> Column:
    """Addresses that the whole page names as canonical or redirects to; comments and scripts say nothing."""
    said = F.regexp_replace(html, r"(?is)<!--.*?-->|<script[\s>].*?</script\s*>", " ")

    def named(tag: str, attribute: str, word: str) -> Column:
        hits = F.when(F.contains(F.lower(html), F.lit(word)), F.regexp_extract_all(said, F.lit(tag), F.lit(0)))
        return F.coalesce(F.transform(hits, lambda t: F.replace(F.regexp_extract(t, attribute, 1), F.lit("&amp;"), F.lit("&"))), F.array().cast("array<string>"))

    found = F.transform(F.concat(named(CANONICAL, HREF, "canonical"), named(REFRESH, GOES_TO, "refresh")), lambda u: resolved(u, url))
    return F.filter(found, lambda u: u.isNotNull())


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row for each row of pages: (id_col, host, path, rule, verdict).

    A page's own rule decides.  Without one, the page takes what is known of its aliases: the connected component of
    its address over canonical links and redirects in the pages and in redirects (source, target: addresses), where
    addresses that differ in scheme, www., closing slash, fragment or tracking parameters are one.  An alias that a
    rule allows makes the component's pages allowed; else one that a rule blocks makes them blocked; else they are allowed.
    Links without a scheme are taken against the page's own address.  A null address, or one without ://, has empty host and path and no alias.  Null and repeated ids are judged like
    others.  Other columns are not read.  An empty table gives an empty result.
    """
    rules = tuple(rules)
    url = F.col(url_col)
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    slim = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), targets_of(html, url).alias("targets"))
    slim = slim.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    slim = materialize(slim, "url-pages")
    links = slim.where("size(targets) > 0 and node is not null").select("node", F.explode("targets").alias("to"))
    if redirects is not None:
        moved = redirects.select(F.col("source"), F.col("target").alias("to")).where(F.contains("source", F.lit("://")) & F.contains("to", F.lit("://")))
        links = links.union(moved.select(node_of(F.col("source")), "to"))
        named = [moved.select(F.col("source").alias("url"))]
    else:
        named = []
    links = materialize(links.withColumn("to_node", node_of(F.col("to"))), "url-links")
    named.append(links.select(F.col("to").alias("url")))
    part = materialize(connected_components(links, "node", "to_node").withColumnRenamed("node", "member"), "url-components")
    known = slim.where("node is not null and own is not null").select("node", F.col("own.verdict").alias("known"))
    for other in named:
        known = known.union(other.select(node_of(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"].alias("known")).where("known is not null"))
    # of each address first, so that a frequent one is a row by the time it is joined
    known = materialize(known.groupBy("node").agg(F.min("known").alias("known")), "url-known")
    told = known.join(part, F.col("node") == F.col("member"), "left").select(F.coalesce("component", "node").alias("c"), "known").groupBy("c").agg(F.min("known").alias("told"))
    told = materialize(told, "url-told")
    open_nodes = materialize(slim.where("own is null and node is not null").select("node").distinct(), "url-open")
    alias = open_nodes.join(part, F.col("node") == F.col("member"), "left").select("node", F.coalesce("component", "node").alias("c"))
    alias = materialize(alias.join(told, "c").where("told = 'block'").select(F.col("node").alias("blocked")), "url-blocked")
    discard(links, part, known, told, open_nodes)
    out = slim.join(alias, F.col("node") == F.col("blocked"), "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked").isNotNull(), "block"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def _fits(host: str, start: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{start}')"


def oracle(rules: Iterable[tuple[str, str, str]] = RULES) -> str:
    """The same for DuckDB, components by recursive reachability."""
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1:]), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered) + " END"
    own = "CASE " + " ".join(f"WHEN {_fits(h, p)} THEN '{a}'" for a, h, p in ordered) + " END"
    split = f"""
      translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host_,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path_,
      array_to_string(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}')), '&') AS query_"""
    node = "regexp_replace(host_, '^www\\.', '') || regexp_replace(path_, '/+$', '') || CASE WHEN query_ = '' THEN '' ELSE '?' || query_ END"

    def parsed(source: str, cols: str) -> str:
        return f"""SELECT *, {rule} AS rule, {own} AS own FROM (
          SELECT {cols}, coalesce(host_, '') AS host, coalesce(path_, '') AS path, CASE WHEN rest IS NOT NULL THEN {node} END AS node FROM (
            SELECT *, {split} FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM {source})))"""

    tag = lambda t: t.replace("'", "''")
    return f"""
    WITH RECURSIVE p AS ({parsed("pages", "page_id, html, url")}),
    s AS (SELECT node, url AS own_url, regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') AS host0, path, regexp_replace(html, '(?is)<!--.*?-->|<script[\\s>].*?</script\\s*>', ' ', 'g') AS said FROM p),
    raw AS (
      SELECT node, own_url, host0, path, replace(regexp_extract(t, '{tag(HREF)}', 1), '&amp;', '&') AS u FROM (SELECT node, own_url, host0, path, unnest(regexp_extract_all(said, '{tag(CANONICAL)}')) AS t FROM s)
      UNION ALL
      SELECT node, own_url, host0, path, replace(regexp_extract(t, '{tag(GOES_TO)}', 1), '&amp;', '&') AS u FROM (SELECT node, own_url, host0, path, unnest(regexp_extract_all(said, '{tag(REFRESH)}')) AS t FROM s)
    ), src AS (
      SELECT node AS node0, CASE
        WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN u
        WHEN u = '' OR starts_with(u, '#') OR regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN NULL
        WHEN starts_with(u, '//') THEN split_part(own_url, '://', 1) || ':' || u
        WHEN starts_with(u, '/') THEN split_part(own_url, '://', 1) || '://' || host0 || u
        WHEN starts_with(u, '?') THEN split_part(own_url, '://', 1) || '://' || host0 || path || u
        ELSE split_part(own_url, '://', 1) || '://' || host0 || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || regexp_replace(u, '^(\\./)+', '') END AS url
      FROM raw WHERE node IS NOT NULL
    ),
    l AS ({parsed("(SELECT * FROM src WHERE url IS NOT NULL)", "node0")}),
    e AS (SELECT node0 AS a, node AS b FROM l WHERE node0 <> node UNION SELECT node, node0 FROM l WHERE node0 <> node),
    reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
    known AS (SELECT node, own FROM p WHERE node IS NOT NULL AND own IS NOT NULL UNION ALL SELECT node, own FROM l WHERE own IS NOT NULL),
    told AS (SELECT coalesce(c, node) AS c, min(own) AS told FROM known LEFT JOIN comp ON a = node GROUP BY 1)
    SELECT page_id, host, path, rule, coalesce(own, told, 'allow') AS verdict
    FROM p LEFT JOIN comp ON comp.a = p.node LEFT JOIN told ON told.c = coalesce(comp.c, p.node)
    """
