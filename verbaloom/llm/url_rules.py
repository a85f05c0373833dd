"""URL verdicts that follow redirects: rules by host and path, then connected components over redirect and canonical links.

A page without a rule of its own takes the verdict of its aliases. Aliases are the pages that one component of the link
graph holds; an explicit allow in a component outweighs a block there. Links are the pages' canonical tags and refreshes,
the redirects that a caller has logged, and those that sites answer by habit: spellings of an address that differ in
scheme, a www. or m. in front, tracking parameters, a fragment, an index page, .html or a last slash lead to one canonical
address. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, need
from .graph import components

Rule = tuple[str, str, str]

#: Verdict, host, path.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Up to so many rules are part of the plan; more are a table that each page's hosts and paths are joined with.
LISTED_RULES = 500
#: Query parameters that say where a visitor came from, not what the page is.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid"


def _host_path(url, which: int):
    part = F.regexp_extract(url, PARTS, which)
    return F.coalesce(ascii_lower(part) if which == 1 else part, F.lit(""))


def with_rules(pages: DataFrame, rules: tuple[Rule, ...], listed_rules: int = LISTED_RULES) -> DataFrame:
    """Adds host, path and __rule, the rule that wins: the longest that fits, an allow before a block of the same length."""
    parts = pages.withColumns({"host": _host_path("url", 1), "path": _host_path("url", 2)})
    kind = "struct<verdict:string,host:string,path:string>"
    if not rules:
        return parts.withColumn("__rule", F.lit(None).cast(kind))
    if len(rules) <= listed_rules:
        listed = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))])
        fits = lambda r: ((F.col("host") == r.host) | F.endswith(F.col("host"), F.concat(F.lit("."), r.host))) & F.startswith(F.col("path"), r.path)
        return parts.withColumn("__rule", F.get(F.filter(listed, fits), F.lit(0)))
    # A host and the domains above it are a few rows for each distinct host and path, however many pages those have.
    table = pages.sparkSession.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")
    lengths = [r.n for r in table.select(F.length("rule_path").alias("n")).distinct().collect()]  # path lengths, not paths
    places = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("path"))
    probes = places.select("host", "path", F.explode(above).alias("rule_host"), starts.alias("starts")).select("host", "path", "rule_host", F.explode("starts").alias("n"))
    probes = probes.withColumn("rule_path", F.expr("left(path, n)"))
    fits = probes.join(table, ["rule_host", "rule_path"])
    best = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), (F.col("verdict") == "allow").alias("allow"), F.struct("verdict", F.col("rule_host").alias("host"), F.col("rule_path").alias("path")).alias("rule")))
    won = fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("__rule"))
    return parts.join(won, ["host", "path"], "left")


def node_of(url):
    """A url as a node: no scheme, no fragment, host in lower case; null if it has no host."""
    host = F.regexp_extract(url, PARTS, 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host != "", F.concat(ascii_lower(host), rest))


def canonical_node(url):
    """The node that all spellings of an address lead to; the node itself where there is nothing to leave out."""
    node = F.regexp_replace(node_of(url), r"^(?:www|m)\.(?=[^/]*\.)", "")
    bare = F.regexp_replace(node, rf"(?<=[?&])(?:{TRACKING})=[^&]*(?:&|$)", "")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    bare = F.regexp_replace(bare, r"(?:/index)?\.html?(?=$|\?)", "")
    return F.regexp_replace(bare, r"(?<=[^/])/(?=$|\?)", "")


def link_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) for each canonical link and refresh redirect of a page: its node and the target's, relative targets resolved."""
    tags = F.explode(F.regexp_extract_all(html_col, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1))
    found = pages.select(F.col(url_col).alias("__url"), tags.alias("__tag"))
    canonical = F.when(F.col("__tag").rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract("__tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("__tag").rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("__tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    target = found.select("__url", F.coalesce(canonical, refresh).alias("__to")).where("__to != ''")
    scheme, site = F.regexp_extract("__url", r"(?s)^(.*?://)", 1), F.regexp_extract("__url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("__url", r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    full = (
        F.when(F.col("__to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("__to"))
        .when(F.startswith("__to", F.lit("//")), F.concat(F.regexp_replace(scheme, "//$", ""), F.col("__to")))
        .when(F.startswith("__to", F.lit("/")), F.concat(site, F.col("__to")))
        .otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), F.lit("")).otherwise(F.lit("/")), F.col("__to")))
    )
    return target.select(node_of("__url").alias("a"), node_of(full).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct()


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None, spellings: bool = True, default: str = "allow", listed_rules: int = LISTED_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page row.

    edges: further (a, b) url pairs, such as a redirect log. spellings: whether spellings of one address are linked. A null
    url or one without :// has an empty host and path, no rule, no aliases and the default verdict. Null html has no
    links. Repeated pages are judged alike. Empty tables give an empty result; other columns are ignored.
    """
    need(pages, id_col, url_col, html_col)
    links = link_edges(pages, url_col=url_col, html_col=html_col)
    known = lambda df: df.where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    if spellings:
        links = links.unionAll(known(pages.select(node_of(url_col).alias("a"), canonical_node(url_col).alias("b"))))
    if edges is not None:
        links = links.unionAll(known(edges.select(node_of("a").alias("a"), node_of("b").alias("b"))))
    members = cut(components(links), "url-components")
    ruled = with_rules(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), rules, listed_rules).withColumn("node", node_of("url"))
    verdicts = ruled.where("__rule IS NOT NULL AND node IS NOT NULL").groupBy("node").agg(F.min("__rule.verdict").alias("v"))
    # Allow sorts before block. Read back, both sides of the next join are plain, and Spark can split a large component.
    held = cut(verdicts.join(members, "node").groupBy("component").agg(F.min("v").alias("decision")), "url-decisions")
    decided = members.join(held, "component").select("node", "decision")
    rule = F.concat("__rule.host", "__rule.path")
    return ruled.join(decided, "node", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce("__rule.verdict", "decision", F.lit(default)).alias("verdict"))
