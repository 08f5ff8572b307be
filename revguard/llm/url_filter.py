"""Operator 6: URL filters by redirect equivalence.

Rules say allow or block for a host, its subdomains and paths that begin with
the rule's; the longest rule that fits decides.  A URL that no rule fits takes
the decision of its aliases: URLs are joined by redirects and canonical links
(``<link rel="canonical">``, ``og:url``, refresh headers, and any redirect table
that is handed in) and by having the same normal form (host in lower case, no
scheme, default port, fragment, tracking parameters or closing slash).
Connected components of these edges are computed as a Spark job; a component
with an explicitly allowed alias is allowed, otherwise one with a blocked alias
is blocked, otherwise the URL is allowed.

Components get only edges between different normal forms; a normal form that
very many pages share is one node, and decisions are summed up by node before
any shuffle of them.  Up to ``MAX_INLINE_RULES`` rules become one constant
expression; longer lists are joined by host suffix and path.

Defined cases: a null url, or one without ``://``, has empty host and path, no
aliases and the verdict allow; null html has no links; repeated rows get one
result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revguard.llm.common import cut_lineage, let, pick
from revguard.llm.graph import components

MAX_INLINE_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\x22\x27]?canonical\b[^>]*>"
OG_URL = r"(?is)<meta\b[^>]*\bproperty\s*=\s*[\x22\x27]?og:url\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\x22\x27]?refresh\b[^>]*>"
RULE_TYPE = "action string, host string, path string"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    u = F.coalesce(url, F.lit(""))
    return F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def normal_form(url: Column) -> Column:
    """Host, path and telling parameters; null for a URL without host."""
    host = F.regexp_replace(host_of(url), ":(80|443)?$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    telling = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(host != "", F.concat(host, path, F.when(telling != "", F.concat(F.lit("?"), telling))
                                       .otherwise(F.lit(""))))


def resolved(link: Column, base: Column) -> Column:
    """A link of a page as an absolute URL; null if it is empty."""
    scheme = F.regexp_extract(base, "^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (F.when((link == "") | (F.instr(F.coalesce(base, F.lit("")), "://") == 0) & (F.instr(link, "://") == 0),
                   F.lit(None).cast("string"))
            .when(F.instr(link, "://") > 0, link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def link_targets(html: Column, url: Column) -> Column:
    """Absolute URLs that a page names as its own address or sends its readers to."""
    page = F.coalesce(html, F.lit(""))

    def attribute(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\x22\x27]?\s*([^\x22\x27\s>]+)", 1)

    raw = F.array(attribute(F.regexp_extract(page, CANONICAL, 0), "href"),
                  attribute(F.regexp_extract(page, OG_URL, 0), "content"),
                  F.regexp_extract(F.regexp_extract(page, REFRESH, 0), r"(?is)\burl\s*=\s*([^\x22\x27\s>]+)", 1))
    links = F.transform(raw, lambda x: F.regexp_replace(x, "&amp;", "&"))
    return F.filter(F.transform(links, lambda x: resolved(x, url)), lambda x: x.isNotNull())


# --- rules ---------------------------------------------------------------------------------------

def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest (action, host, path) that fits, as a struct (size, action, rule); null if none does."""
    if not rules:
        return F.lit(None).cast("struct<size:int,allows:boolean,action:string,rule:string>")

    def one(action: str, rule_host: str, rule_path: str) -> Column:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        return F.when(fits, F.struct(F.lit(len(rule_host + rule_path)).alias("size"),
                                     F.lit(action == "allow").alias("allows"), F.lit(action).alias("action"),
                                     F.lit(rule_host + rule_path).alias("rule")))

    found = [one(*r) for r in rules]
    return found[0] if len(found) == 1 else F.greatest(*found)


def with_rule(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and action of the longest rule that fits; among equally long ones allow wins."""
    placed = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if rules.limit(MAX_INLINE_RULES + 1).count() <= MAX_INLINE_RULES:
        listed = [(r["action"], r["host"], r["path"]) for r in rules.select("action", "host", "path").collect()]
        out = placed.withColumn("__rule", fitting_rule(F.col("host"), F.col("path"), listed))
        return out.withColumns({"rule": F.col("__rule.rule"), "action": F.col("__rule.action")}).drop("__rule")
    # each host and path once, so that a host with very many pages costs no more than its different paths
    pairs = placed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("action").alias("r_action"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    met = (pairs.withColumn("r_host", F.explode(suffixes)).join(r, "r_host")
           .where(F.col("path").startswith(F.col("r_path"))))
    name = F.concat("r_host", "r_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(
        F.length(name).alias("size"), (F.col("r_action") == "allow").alias("allows"), F.col("r_action").alias("action"),
        name.alias("rule"))).alias("best"))
    return (placed.join(best, ["host", "path"], "left")
            .withColumns({"rule": F.col("best.rule"), "action": F.col("best.action")}).drop("best"))


# --- verdicts ------------------------------------------------------------------------------------

def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict and via (rule, alias or default) of every row.

    ``rules`` has action, host and path; ``redirects``, if given, source and target URLs.
    """
    own = pick(pages, "page_id", "url", "html")
    linked = own.select("page_id", "url", let(F.col("html"), lambda h: link_targets(h, F.col("url"))).alias("targets"))
    rows = cut_lineage(with_rule(linked, rules).withColumn("node", normal_form(F.col("url"))))
    pairs = rows.select(F.col("url").alias("source"), F.explode("targets").alias("target"))
    if redirects is not None:
        pairs = pairs.unionByName(pick(redirects, "source", "target").where("source is not null and target is not null"))
    pairs = cut_lineage(pairs.distinct())
    ends = pairs.select(F.col("source").alias("url")).unionByName(pairs.select(F.col("target").alias("url"))).distinct()
    named = with_rule(ends, rules).select(normal_form(F.col("url")).alias("node"), "action")
    edges = pairs.select(normal_form(F.col("source")).alias("u"), normal_form(F.col("target")).alias("v"))
    roots = components(edges.where("u is not null and v is not null"))
    # what is said of each node, then of each component
    said = (rows.select("node", "action").unionByName(named).where("node is not null and action is not null")
            .groupBy("node").agg(F.bool_or(F.col("action") == "allow").alias("allows"),
                                 F.bool_or(F.col("action") == "block").alias("blocks")))
    by_root = (said.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
               .agg(F.bool_or("allows").alias("allows"), F.bool_or("blocks").alias("blocks")))
    # nodes with an alias: themselves, or any node of their component
    alias = (by_root.select(F.col("root").alias("node"), "allows", "blocks")
             .unionByName(roots.where("node <> root").join(by_root, "root").select("node", "allows", "blocks")))
    open_rows, ruled = rows.where("action is null"), rows.where("action is not null")
    taken = open_rows.join(alias, "node", "left")
    verdict = F.when(F.col("blocks") & ~F.col("allows"), F.lit("block")).otherwise(F.lit("allow"))
    via = F.when(F.col("allows").isNull(), F.lit("default")).otherwise(F.lit("alias"))
    columns = ["page_id", "url", "host", "path", "rule"]
    return (ruled.select(*columns, F.col("action").alias("verdict"), F.lit("rule").alias("via"))
            .unionByName(taken.select(*columns, verdict.alias("verdict"), via.alias("via"))))
