"""URL filters by redirect equivalence.

Addresses that redirect or declare a canonical link to one another are aliases. Rules on host and path
decide first; connected components over the alias edges then carry block decisions to the addresses
that no rule names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from timeloom.operators.graph import connected_components
from timeloom.plans.scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule list becomes one CASE expression; longer lists belong in a table joined by host suffix.
MAX_RULES = 500


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """The node of a URL in the alias graph: host without a default port, path without ``.`` and ``..`` (``/`` if empty) and
    query; no scheme and fragment; null without ``://``."""
    host = F.regexp_replace(host_of(url), r":(?:80|443)?$", "")
    parts = F.split(F.regexp_replace(path_of(url), "^/", ""), "/", -1)
    whole = F.aggregate(
        F.transform(parts, lambda x, i: F.struct(x.alias("x"), (i == F.size(parts) - 1).alias("last"))), F.array().cast("array<string>"),
        lambda done, p: F.when(p["x"] == "..", F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.when(p["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))
        .when(p["x"] == ".", F.when(p["last"], F.array_append(done, F.lit(""))).otherwise(done)).otherwise(F.array_append(done, p["x"])),
    )
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*([?][^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, F.lit("/"), F.array_join(whole, "/"), query))


def resolved(target: Column, base: Column) -> Column:
    """A link's target as a URL, seen from the URL ``base``; null for other schemes than those with ``://``."""
    start = F.concat(F.lit("http://"), host_of(base))
    path = path_of(base)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(start, target))
        .when(target.startswith("?"), F.concat(start, path, target))
        .when((target == "") | target.startswith("#"), base)
        .otherwise(F.concat(start, F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")), target))
    )


def _value(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not, with the character references that URLs hold decoded; null without it."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^"'\s>]++)""", 1)
    plain = F.btrim(F.regexp_replace(found, r"""^["']|["']$""", ""))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)&(?:amp|#38|#x26);", "&"), r"(?i)&(?:#47|#x2f|sol);", "/")
    return F.when(found != "", plain)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action, both null if none does.

    ``rules``: (action, host + path). A rule fits its host and all subdomains if the path starts with the
    rule's path. Of equally long rules the one with the longer host wins, then the smaller string.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name = action = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].find("/"), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        action = F.when(fits, verdict) if action is None else action.when(fits, verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst`` addresses from canonical links and from redirects by meta refresh in the pages' HTML.

    Targets are seen from the page's ``base`` element, else from its URL (``resolved``). Tags in comments, scripts, styles
    and templates don't count. Pages without address, html or such a tag give no edge, nor do links to the page itself.
    """
    # explode of a single value keeps each step computed once: filters aren't pushed through it
    once = lambda c: F.explode(F.array(c))
    t = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("from"), once(F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|noscript|textarea)\b.*?(?:</\1\s*+>|\z)", "")).alias("html"))
    # possessive throughout, and what isn't closed is taken to the end: Java's matcher neither recurses nor starts over from each tag
    tags = F.regexp_extract_all(F.concat("html", F.lit("\n")), F.lit(r"""(?is)<(?:link|meta|base)\b(?:[^>"']++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""), F.lit(0))
    t = t.select("from", once(F.filter(tags, lambda x: x.endswith(">"))).alias("tags"))
    base = F.try_element_at(F.filter("tags", lambda x: x.rlike(r"(?i)^<base\b")), F.lit(1))
    wanted = F.filter("tags", lambda x: _value(x, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)") | _value(x, "http-equiv").rlike(r"(?i)^refresh$"))
    t = t.select("from", F.coalesce(resolved(_value(base, "href"), F.col("from")), "from").alias("base"), F.explode(wanted).alias("tag"))
    refresh = F.regexp_extract(_value(F.col("tag"), "content"), r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
    target = F.when(F.col("tag").rlike(r"(?i)^<link\b"), _value(F.col("tag"), "href")).otherwise(F.nullif(F.btrim(refresh), F.lit("")))
    t = t.select("from", "base", once(target).alias("target")).where("target is not null")
    t = t.select("from", once(resolved(F.col("target"), F.col("base"))).alias("to"))
    ends = t.select(once(F.struct(address_of(F.col("from")).alias("src"), address_of(F.col("to")).alias("dst"))).alias("e"))
    return ends.select("e.*").where("src is not null and dst is not null and src <> dst")


def judge_urls(pages: DataFrame, edges: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Add ``host, path, rule, verdict, alias_verdict`` to ``pages`` (column ``url``).

    verdict: the action of the fitting rule; else what the aliases say; else ``default``. A component whose
    addresses hold a rule's block passes the block on to members without a rule, unless another member holds
    an explicit allow, which takes precedence. The members of ``edges`` (src, dst) need not be pages.
    Null URLs and URLs without ``://`` have empty host and path and no alias. Repeated rows are each judged;
    other columns of pages are kept unless they carry one of the names above, in which case they are replaced.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.drop("host", "path", "rule", "verdict", "alias_verdict").withColumns({"host": host, "path": path}).withColumns({"rule": rule, "_action": action, "_address": address_of(F.col("url"))})
    members = connected_components(edges)
    node_url = F.concat(F.lit("http://"), F.col("node"))
    _, of_node = rule_for(host_of(node_url), path_of(node_url), rules)
    classes = members.select("component", of_node.alias("a")).groupBy("component").agg(F.max(F.col("a") == "block").alias("blocked"), F.max(F.col("a") == "allow").alias("allowed"))
    classes = materialise(classes, "alias-classes")  # so that the join below can be split where one component is large
    says = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block")
    aliases = members.join(classes, "component").select(F.col("node").alias("_address"), says.alias("alias_verdict")).where("alias_verdict is not null")
    return judged.join(aliases, "_address", "left").withColumn("verdict", F.coalesce("_action", "alias_verdict", F.lit(default))).drop("_action", "_address")


#: The rules of op1, fixed by its contract.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_redirect_equivalence(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    edges = alias_edges(pages)
    return judge_urls(pages.select("page_id", "url"), edges, RULES).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
#: The given pages hold no redirect or canonical tag (a test has some), so here the rules alone decide.
OP1_SQL = f"""
with p as (select page_id, coalesce({_HOST}, '') as host, coalesce({_PATH}, '') as path from pages),
r(rule, h, p, verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
select page_id, host, path,
  (select arg_max(rule, length(rule)) from r where (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.p)) as rule,
  coalesce((select arg_max(verdict, length(rule)) from r where (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.p)), 'allow') as verdict
from p
"""
