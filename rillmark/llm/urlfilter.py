"""URL filters with redirect equivalence. DataFrame and SQL functions only.

Each page's url gets the longest rule that fits its host and path. Redirect and canonical-link edges
between urls, taken from the pages' html or given as a table, make classes of equivalent urls by
distributed connected components; a block (or allow) decision of one member holds for its aliases
that no rule fits, and an allow in the class goes before a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import stored

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Rules up to this number are a literal in the plan; more are joined by host suffix.
LITERAL_RULES = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    at = F.locate("://", url)
    rest = url.substr(at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(F.coalesce(at, F.lit(0)) > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    at = F.locate("://", url)
    rest = url.substr(at + 3, F.length(url))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) > 0, path).otherwise(F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all the domains that it is part of."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1))
    )


def with_rule(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds rule (host and path of the longest fitting rule, else null) and rule_verdict.

    pages has host and path. Of rules of equal length the one with the longer host goes first, then an
    allow. rules: a short list, or a table (host, path, verdict) of any size, which is joined by the
    suffixes of the distinct hosts.
    """
    if isinstance(rules, list) and len(rules) <= LITERAL_RULES:
        if not rules:
            return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
        ordered = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2]))
        fits = [
            (((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), h + p, v)
            for h, p, v in ordered
        ]
        rule = verdict = None
        for cond, text, v in fits:
            rule = F.when(cond, text) if rule is None else rule.when(cond, text)
            verdict = F.when(cond, v) if verdict is None else verdict.when(cond, v)
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
    table = table.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("_v"))
    # one row for each distinct host and path: a hot host meets the rules once
    places = pages.select("host", "path").distinct()
    best = (
        places.withColumn("rule_host", F.explode(_suffixes(F.col("host"))))
        .join(table, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .withColumn("_rule", F.concat("rule_host", "rule_path"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(F.length("_rule").alias("n"), F.length("rule_host").alias("h"), (F.col("_v") == "allow").alias("a"), F.col("_rule").alias("rule"), F.col("_v").alias("v"))
            ).alias("b")
        )
        .select("host", "path", F.col("b.rule").alias("rule"), F.col("b.v").alias("rule_verdict"))
    )
    return pages.join(best, ["host", "path"], "left")


def alias_key(url: Column) -> Column:
    """The url as a node: scheme and host in lower case, without the fragment."""
    head = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url.substr(F.length(head) + 1, F.length(url)), r"(?s)^([^#]*)", 1)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.when(rest == "", F.lit("/")).otherwise(rest))


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.replace(F.regexp_replace(value, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))


def _without_dots(path: Column) -> Column:
    """The path, which begins with /, without . and .. segments."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    fold = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), none, fold)
    # a last . or .. is a folder
    ended = F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))
    return F.when(path.rlike(r"(?s)/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def resolved(links: DataFrame) -> DataFrame:
    """Adds absolute, the url that (url, target) means: target may be absolute, or relative to scheme, host, folder, page
    (from ? on) or to the url but for its fragment. Relative ones lose their dot segments."""
    target = F.col("target")
    parts = links.withColumns(
        {
            "_scheme": F.regexp_extract("url", r"^([^:/?#]+):", 1),
            "_root": F.regexp_extract("url", r"(?s)^([^:/?#]*://[^/?#]*)", 1),
            "_path": F.regexp_extract("url", r"(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1),
            "_query": F.regexp_extract("url", r"(?s)^[^?#]*(\?[^#]*)", 1),
            "_host": F.regexp_extract("target", r"(?s)^(//[^/?#]*)", 1),
        }
    )
    parts = parts.withColumn("_own", F.regexp_extract(target.substr(F.length("_host") + 1, F.length(target)), r"(?s)^([^?#]*)", 1))
    parts = parts.withColumn("_tail", target.substr(F.length("_host") + F.length("_own") + 1, F.length(target)))
    folder = F.regexp_extract("_path", "(?s)^(.*/)", 1)
    whole = F.when((F.col("_host") != "") | F.col("_own").startswith("/"), F.col("_own")).when(F.col("_own") == "", F.col("_path"))
    whole = whole.otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), "_own"))
    parts = parts.withColumn("_whole", F.when(whole == "", "/").otherwise(whole))
    path = F.when((F.col("_own") == "") & (F.col("_host") == ""), F.col("_whole")).otherwise(_without_dots(F.col("_whole")))
    query = F.when((F.col("_own") == "") & (F.col("_host") == "") & ~target.startswith("?"), F.col("_query")).otherwise("")
    root = F.when(F.col("_host") == "", F.col("_root")).otherwise(F.concat("_scheme", F.lit(":"), "_host"))
    return parts.withColumn("absolute", F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).otherwise(F.concat(root, path, query, "_tail"))).drop(
        "_scheme", "_root", "_path", "_query", "_host", "_own", "_tail", "_whole"
    )


#: What isn't markup: comments, and the content of elements that hold text alone. Tags that matter are matched first and stay, so
#: that an attribute's value doesn't begin a comment. What isn't closed goes to the end of the page.
_TEXT = r"""(?is)(<(?:link|meta|base)\s[^>]*>)|<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]).*?(?:</\2(?=[\s/>])|\z)"""


def markup(html: Column) -> Column:
    """The page without comments and without what scripts, styles and text fields hold."""
    return F.regexp_replace(html, _TEXT, "$1")


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes: each page's canonical link and meta refresh. Pages without either give none. Targets are
    relative to the page's first base element with href, where there is one. Comments, scripts, styles and text fields hold no
    links."""
    html = F.col("html")
    marked = pages.where((F.locate("://", "url") > 0) & html.rlike("(?i)canonical|http-equiv")).withColumn("html", markup(html))
    base = F.trim(_attribute(F.regexp_extract(html, r"(?is)(<base\s(?:[^>]*\s)?href\s*=[^>]*>)", 1), "href"))
    tags = marked.select("url", base.alias("base"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), F.lit(1))).alias("tag"))
    tag = F.col("tag")
    read = tags.select(
        "url", "base", _attribute(tag, "rel").alias("rel"), _attribute(tag, "href").alias("href"), _attribute(tag, "http-equiv").alias("equiv"), _attribute(tag, "content").alias("content")
    )
    target = F.when(F.col("rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), F.col("href")).when(
        F.lower("equiv") == "refresh", F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    )
    # written here: filters that are pushed below would repeat the expressions of every step
    links = stored(read.select("url", "base", F.trim(target).alias("target")), "links").where(F.length("target") > 0)
    # without a base element the base is empty, which means the url itself
    based = resolved(links.select("url", F.col("base").alias("target"), F.col("target").alias("link")))
    found = resolved(based.select(F.col("url").alias("page"), F.col("absolute").alias("url"), F.col("link").alias("target")))
    return found.select(alias_key(F.col("page")).alias("a"), alias_key(F.col("absolute")).alias("b"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph (a, b): one row (node, component) for each node with an
    edge, component being the least node reachable.

    Alternating large-star and small-star rounds: the number of edges never grows beyond that of nodes
    and edges, a hub's neighbours are only min-aggregated and joined (never gathered), and rounds are
    logarithmic. Each round is written to the shared folder. Null ends are ignored.
    """
    edges = stored(edges.select("a", "b"), "edges")
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stored(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _fingerprint(now)
    if not mark[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        # written, so that both sides of the join are plain exchanges: then Spark can split a hub's rows
        low = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        # large star: greater neighbours go to the least neighbour
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        now = stored(small.where(F.col("a") != F.col("b")).distinct(), "edges")
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components: not settled in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """The number of edges and two combinations of their hashes: equal sets have equal ones, others differ but for
    chance (2**-64)."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 24))).head())


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row for each page: page_id, url, host, path, rule, verdict and component_id.

    verdict is the longest fitting rule's. Where no rule fits it is the class's: allow if a rule allows
    any url of the class, else block if a rule blocks one, else allow. A class holds the urls joined by
    redirect and canonical edges (from html, and from edges (a, b) of urls if given) and the urls equal
    but for the fragment and the case of scheme and host; component_id is the least such url. Urls that
    only occur as an edge's end are judged too and pass their decision on. A null url or one without ://
    has empty host and path, fits no rule, belongs to no class (component_id null) and is allowed. Null
    html has no edges; an empty table gives an empty result; other columns are ignored.
    """
    base = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = with_rule(base, rules).withColumn("node", F.when(F.locate("://", "url") > 0, alias_key(F.col("url"))))
    found = link_edges(pages)
    if edges is not None:
        found = found.union(edges.select(alias_key(F.col("a")), alias_key(F.col("b"))))
    member = components(found)
    # urls of the graph that are no page's have a rule's decision as well
    ends = member.select(F.col("node").alias("url")).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("url").alias("node"))
    facts = with_rule(ends, rules).select("node", "rule_verdict").union(base.where("node is not null").select("node", "rule_verdict"))
    votes = facts.groupBy("node").agg(
        F.max((F.col("rule_verdict") == "allow").cast("int")).alias("allows"), F.max((F.col("rule_verdict") == "block").cast("int")).alias("blocks")
    )
    voted = votes.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = voted.groupBy("component").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks"))
    by_node = (
        voted.select("node", "component")
        .join(classes, "component")
        .select("node", F.col("component").alias("component_id"), F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").otherwise("allow").alias("class_verdict"))
    )
    return base.join(by_node, "node", "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", "class_verdict", F.lit("allow")).alias("verdict"), "component_id"
    )
