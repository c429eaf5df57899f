"""URL rules whose decisions reach every alias of an address."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandcast.llm.components import components
from demandcast.session import materialize

#: Query parameters that don't change what an address shows.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid", "sessionid")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINK = r"(?is)<link\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*http-equiv\s*=\s*[\x22\x27]?refresh\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\x22\x27]?canonical\b"
HREF = r"(?is)\bhref\s*=\s*(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27|([^\s\x22\x27>]+))"
TARGET = r"(?is)\bcontent\s*=\s*(?:\x22[^\x22]*?url\s*=\s*\x27?([^\x22\x27]*)\x22|\x27[^\x27]*?url\s*=\s*\x22?([^\x22\x27]*)\x27)"


def host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty where there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """One text for all spellings of an address: host, path and query without scheme,
    fragment, default port, trailing slash and tracking parameters. Null without `://`."""
    clean_host = F.regexp_replace(host(url), r":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({'|'.join(TRACKING)})(=|$)"))
    clean_path = F.regexp_replace(path(url), "/+$", "")
    text = F.concat(clean_host, clean_path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), text)


def _resolved(link: Column, base: Column) -> Column:
    """`link` as an absolute address, seen from `base`; null if empty or of another kind."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    folder = F.regexp_extract(base, r"^.*?://[^?#]*/", 0)
    top = F.concat(scheme, F.lit("://"), host(base))
    link = F.trim(link)
    return (
        F.when(F.contains(link, F.lit("://")), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(top, link))
        .when((link != "") & ~link.rlike(r"^([#?]|[a-zA-Z][a-zA-Z0-9+.-]*:)"), F.concat(F.when(folder != "", folder).otherwise(F.concat(top, F.lit("/"))), link))
    )


def _first(text: Column, pattern: str, groups: int) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, pattern, g), F.lit("")) for g in range(1, groups + 1)), F.lit(""))


def links(pages: DataFrame) -> DataFrame:
    """(source, target): URLs of a page and of its canonical link or refresh target, resolved."""
    html = F.coalesce(F.col("html"), F.lit(""))
    canonical = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda tag: tag.rlike(CANONICAL))
    refresh = F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0))
    targets = F.concat(
        F.transform(canonical, lambda tag: _first(tag, HREF, 3)), F.transform(refresh, lambda tag: _first(tag, TARGET, 2))
    )
    named = pages.where(html.rlike(r"(?is)<link\b|http-equiv")).select("url", F.explode(targets).alias("target"))
    return named.select(F.col("url").alias("source"), _resolved(F.col("target"), F.col("url")).alias("target"))


def _rule(rules, where: Column, way: Column, fields) -> Column:
    """The field of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((where == name) | where.endswith("." + name)) & way.startswith(slash + rest)
        out = F.when(fits, F.lit({"rule": rule, "verdict": verdict}[fields])).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """Every column of `pages` and host, path, rule, verdict (these names are replaced).

    `pages` has url and html; `rules` are (allow or block, "host/path") pairs; a
    rule fits its host and all subdomains where the path starts with the rule's,
    and the longest one wins. `redirects` may hold further (source, target) URLs.

    A page with a rule has that rule's verdict. Any other takes its class's: pages
    with one address (scheme, fragment, tracking parameters and trailing slash
    aside), canonical links and redirects form classes by connected components. A
    class with an allowed address is allowed, else one with a blocked address is
    blocked, else allowed. Addresses that are only link targets count too.

    Null URLs and those without `://` have empty host and path, no rule, no
    aliases, and are allowed. Null html has no links. Repeated pages get equal
    rows; an empty table gives an empty one. Rules are compiled into the plan.
    """
    named = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    named = named.withColumn("rule", _rule(rules, F.col("host"), F.col("path"), "rule"))
    named = named.withColumn("verdict", _rule(rules, F.col("host"), F.col("path"), "verdict"))
    linked = links(pages)
    if redirects is not None:
        linked = linked.unionByName(redirects.select("source", "target"))
    linked = linked.withColumns({"a": address(F.col("source")), "b": address(F.col("target"))})
    linked = materialize(linked.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    edges = linked.where("a <> b").select("a", "b").distinct()
    classes = materialize(components(edges), "classes")

    def seeds(urls):
        verdict = _rule(rules, host(F.col("url")), path(F.col("url")), "verdict")
        return urls.select(address(F.col("url")).alias("node"), verdict.alias("own")).where("node IS NOT NULL AND own IS NOT NULL")

    # Judged by the whole URL: the address has lost a trailing slash that rules may ask for.
    ends = linked.select(F.explode(F.array("source", "target")).alias("url")).distinct()
    found = seeds(pages.select("url")).unionByName(seeds(ends)).join(classes, "node", "left")
    # A URL's own class is its address; classes of linked addresses are their components.
    head = F.coalesce(F.col("component"), F.col("node"))
    decided = found.groupBy(head.alias("class")).agg(
        F.min("own").alias("class_verdict")  # allow before block
    )
    open_ = named.where("verdict IS NULL").withColumn("node", address(F.col("url")))
    open_ = open_.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    open_ = open_.join(decided, "class", "left").withColumn("verdict", F.coalesce("class_verdict", F.lit("allow")))
    return named.where("verdict IS NOT NULL").unionByName(open_.select(*named.columns))
