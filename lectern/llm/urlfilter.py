"""URL filters with redirect equivalence (operator 8).

A url that a rule fits has that rule's verdict. Any other takes part in its equivalence class: pages, the
targets of their canonical links and of their refresh redirects, joined by connected components. A class with an
explicitly allowed url allows its other members; else one with a blocked url blocks them; else they are allowed.
"""

from __future__ import annotations

import dataclasses
import html
import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.components import connected_components
from lectern.llm.linededup import ascii_lower


@dataclasses.dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def rule(verdict: str, where: str) -> Rule:
    """rule("block", "example.org/es/"): host, then a path from the first slash on."""
    if verdict not in ("allow", "block"):
        raise ValueError(verdict)
    host, slash, path = where.partition("/")
    return Rule(host, slash + path, verdict == "allow")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as (rule, allow), or null; of equally long ones an allowing one."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), not r.allow, r.text))
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


_ATTRIBUTE = r"""\s*=\s*["']?\s*([^"'\s>]+)"""


def links(html: Column) -> Column:
    """Canonical-link and refresh-redirect targets of a page, as written."""
    html = F.coalesce(html, F.lit(""))
    canonical = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?\s*canonical\b"""))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""))
    targets = F.concat(F.transform(canonical, lambda t: F.regexp_extract(t, rf"(?i)\bhref{_ATTRIBUTE}", 1)), F.transform(refresh, lambda t: F.regexp_extract(t, rf"(?i)\burl{_ATTRIBUTE}", 1)))
    return F.filter(targets, lambda t: t != "")


@F.udf(returnType=T.StringType(), useArrow=False)
def absolute(target: str | None, base: str | None) -> str | None:
    """A link target seen from a page, entities decoded and relative to the page's url; null where it has a scheme without `://`, or the page has none."""
    target = html.unescape(target or "").strip()
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", target):
        return target
    scheme = re.match(r"([^:/?#]+)://", base or "")
    if not scheme or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", target):
        return None
    try:
        # The standard library resolves known schemes only; the path and query are resolved alike for all.
        return scheme[1] + urljoin("http" + base[scheme.end(1) :], target)[4:]
    except ValueError:
        return None


def node(url: Column) -> Column:
    """What makes two urls one: the fragment is dropped, scheme and host are lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)), F.lit("://"), host_of(url), rest))


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    url = F.col(f"`{url_col}`")
    found = pages.select(url.alias("url"), F.explode(links(F.col(f"`{html_col}`"))).alias("target"))
    return found.select(node(F.col("url")).alias("a"), node(absolute(F.col("target"), F.col("url"))).alias("b")).where("a <> b").distinct()


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; redirects (a, b) adds known equivalences of urls.

    A null url, or one without `://`, has an empty host and path, fits no rule and belongs to no class: it is
    allowed. Repeated rows stay, null ids stay null, null html has no links, other columns are ignored.
    """
    url = F.col(f"`{url_col}`")
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    classes = connected_components(edges)
    named = classes.withColumn("m", match(host_of(F.col("node")), path_of(F.col("node")), rules))
    verdicts = named.groupBy("component").agg(F.max(F.when(F.col("m").isNotNull(), F.col("m.allow"))).alias("any_allowed"))
    by_node = classes.join(verdicts, "component").where("any_allowed is not null").select("node", "any_allowed")
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node(url).alias("node"))
    own = own.withColumn("m", match(F.col("host"), F.col("path"), rules))
    allowed = F.coalesce(F.col("m.allow"), F.col("any_allowed"), F.lit(True))
    return own.join(by_node, "node", "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"))


#: The rules of the contract query.
RULES = [rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/")]

_HOST = "lower(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1))"
_PATH = "regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_NODE = "case when contains({u}, '://') then lower(regexp_extract({u}, '^((?s:.*?))://', 1)) || '://' || " + _HOST + " || regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^#]*)', 1) end"


def _sql_match(what: str) -> str:
    cases = " ".join(f"when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then {what.format(r=r, v=str(r.allow).lower(), t=repr(r.text))}" for r in sorted(RULES, key=lambda r: -len(r.text)))
    return f"case {cases} end"


ORACLE = f"""
with recursive raw as (
  select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages
),
tags as (
  select url, unnest(regexp_extract_all(html, '(?i)<link\\b[^>]*>')) as tag, 'rel' as kind from raw
  union all
  select url, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*>')), 'meta' from raw
),
targets as (
  select url, case kind
    when 'rel' then case when regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?\\s*canonical\\b') then regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) end
    else case when regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b') then regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) end
  end as target from tags
),
seen as (
  select url, case
    when contains(target, '://') then target
    when target like '//%' then regexp_extract(url, '^([^:/?#]*):', 1) || ':' || target
    when target like '/%' and contains(url, '://') then regexp_extract(url, '^([^:/?#]*):', 1) || '://' || {_HOST.format(u="url")} || target
  end as target from targets where target <> ''
),
edges as (select distinct {_NODE.format(u="url")} as a, {_NODE.format(u="target")} as b from seen),
both_ways as (select a, b from edges where a <> b union select b, a from edges where a <> b),
reach(node, other) as (select a, a from both_ways union select r.node, e.b from reach r join both_ways e on r.other = e.a),
fits as (
  select *, {_sql_match("{v}")} as allow from (select node, {_HOST.format(u="other")} as host, {_PATH.format(u="other")} as path from reach)
),
class as (select node, bool_or(allow) as any_allowed from fits where allow is not null group by node),
own as (
  select page_id, {_NODE.format(u="url")} as node, {_HOST.format(u="url")} as host, {_PATH.format(u="url")} as path from raw
),
judged as (select *, {_sql_match("{t}")} as rule, {_sql_match("{v}")} as allow from own)
select j.page_id, j.host, j.path, j.rule, case when coalesce(j.allow, c.any_allowed, true) then 'allow' else 'block' end as verdict
from judged j left join class c on j.node = c.node
"""
