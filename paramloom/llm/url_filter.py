"""URL rules with decisions carried over to aliases.

A rule names a host (with all its subdomains) and a path prefix; the longest
that fits decides a page. Pages without one follow their aliases: URLs that
differ only in scheme, a leading www., fragment, tracking parameters or a
closing slash are one address, and addresses that redirect or name each other
as canonical (``rel=canonical``, ``http-equiv=refresh``, or a given table of
redirects) are connected components. Links are read from every link and meta
tag outside comments and raw text, with attributes in any order and quoting;
relative targets are resolved against the page's URL or its base tag. If a rule explicitly allows a page of
the component its undecided pages are allowed; else if a rule blocks one they
are blocked; else they are allowed.

Scale. Rules are a fixed short list, evaluated in one expression. Only html
with such a tag goes to Python, which reads it in one pass. Addresses
become integers by a distributed sort; components run on edges between
different addresses only; the decisions of an address are gathered with
map-side aggregation, so one that many pages share meets in no single task.

Edge cases. A null URL, or one without ``://``, has an empty host and path,
no address and so no aliases: allowed. Repeated rows are decided alike. Empty
table: empty result. Other columns are not read (html may be missing).
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm.graph import components
from paramloom.llm.scratch import Scratch, bounded_batches, named

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CANONICAL and REFRESH are what the SQL reads; targets() reads all that they do and more.
CANONICAL = r"""(?is)<link\s[^>]*rel\s*=\s*["']?canonical["']?[^>]*href\s*=\s*["']([^"'>]+)"""
REFRESH = r"""(?is)<meta\s[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*url\s*=\s*([^"'>\s]+)"""
_TAG = re.compile(r"<!--|<(link|meta|base|script|style|textarea|title)(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s>/][^\s=>/]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?)?+""")
_TURN = re.compile(r"""(?is)\s*+[\d.]*+[\s;,]*+(?:url\s*+=\s*+)?+(?:"([^"]*)|'([^']*)|(\S.*))""")
_ABSOLUTE = re.compile(r"[a-z][a-z0-9+.-]*://", re.I)
_ENDS = {k: re.compile(f"</{k}(?=[\\s/>])", re.I) for k in ("script", "style", "textarea", "title")}


def _joined(base: str, target: str) -> str:
    if _ABSOLUTE.match(target):
        return target
    try:
        return urljoin(base, target)
    except ValueError:
        return target


def targets(url: str, text: str) -> list[str]:
    """The URLs that a page names as canonical or turns to."""
    found, base, at = [], None, 0
    while tag := _TAG.search(text, at):
        name, at = (tag[1] or "").lower(), tag.end()
        if not name:
            at = text.find("-->", tag.start() + 2)
            if at < 0:
                break
            continue
        has: dict[str, str] = {}
        while m := _ATTRIBUTE.match(text, at):
            has.setdefault(m[1].lower(), entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")).strip())
            at = m.end()
        if name in _ENDS:
            end = _ENDS[name].search(text, at)
            if not end:
                break
            at = end.end()
        elif name == "base":
            base = has.get("href") if base is None else base
        elif name == "link" and "canonical" in has.get("rel", "").lower().split():
            found.append(has.get("href", ""))
        elif name == "meta" and has.get("http-equiv", "").lower() == "refresh" and (m := _TURN.match(has.get("content", ""))):
            found.append((m[1] or m[2] or m[3] or "").strip())
    base = _joined(url, base) if base else url
    return [_joined(base, x) for x in dict.fromkeys(found) if x]


def _read(batches):
    for batch in batches:
        urls, texts = batch.column("url").to_pylist(), batch.column("html")
        found = [targets(u or "", t.as_py()) if t.is_valid else [] for u, t in zip(urls, texts)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.list_(pa.string()))], names=["page_id", "url", "targets"])


def _sql(url: str) -> dict[str, str]:
    """SQL of both engines for the parts of a URL."""
    rest = f"case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) else '' end"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*[?]([^#]*)', 1)"
    query = f"regexp_replace(regexp_replace({query}, '(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?', '', 'g'), '^&', '')"
    return {"host": host, "path": path, "query": query}


def _spark(text: str) -> str:
    return text.replace("strpos(", "instr(").replace(", 'g')", ")")


def _address(host: str, path: str, query: str) -> str:
    return f"nullif(concat(regexp_replace({host}, '^www[.]', ''), regexp_replace({path}, '/+$', ''), case when {query} = '' then '' else concat('?', {query}) end), '')"


def _rule_case(what: int) -> str:
    """what: 0 the rule's verdict, 1 its name. Longest first."""
    cases = ""
    for verdict, host, path in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)):
        cases += f" when (host = '{host}' or right(host, {len(host) + 1}) = '.{host}') and left(path, {len(path)}) = '{path}' then '{(verdict, host + path)[what]}'"
    return f"case{cases} end"


def _parts(df: DataFrame, url: str, into: str) -> DataFrame:
    sql = {k: _spark(v) for k, v in _sql(url).items()}
    df = df.withColumns({f"{into}{k}": F.expr(f"coalesce({v}, '')") for k, v in sql.items()})
    return df.withColumn(f"{into}address", F.expr(_address(f"{into}host", f"{into}path", f"{into}query")))


def filter_urls(spark: SparkSession, pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict per page. redirects: optional rows (source, target) of URLs."""
    s = Scratch(spark, "urls")
    bounded_batches(spark)
    html = "cast(html as string)" if "html" in pages.columns else "cast(null as string)"
    df = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", f"{html} as html")
    df = df.withColumn("html", F.when(F.col("html").rlike(r"(?i)<(link|meta)[\s/]"), F.col("html")))
    df = _parts(df.mapInArrow(_read, "page_id long, url string, targets array<string>"), "url", "")
    df = df.withColumn("rule", F.expr(_rule_case(1))).withColumn("own", F.expr(_rule_case(0)))
    df = s.save(df.drop("query"), "pages")

    edges = df.select("url", F.explode("targets").alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.selectExpr("cast(source as string) as url", "cast(target as string) as target"))
    edges = _parts(_parts(edges, "url", "a_"), "target", "b_").select(F.col("a_address").alias("x"), F.col("b_address").alias("y"))
    edges = s.save(edges.filter("x <> y").distinct(), "edges")
    addresses = named(s, edges.select(F.col("x").alias("address")).unionByName(edges.select(F.col("y").alias("address"))).distinct(), "addresses", "node")
    numbered = edges.join(addresses.select(F.col("address").alias("x"), F.col("node").alias("a")), "x").join(
        addresses.select(F.col("address").alias("y"), F.col("node").alias("b")), "y"
    )
    linked = components(s, numbered.select("a", "b"))
    of = s.save(addresses.join(linked, "node").select("address", "component"), "components")

    df = df.join(of, "address", "left").withColumn(
        "alias", F.when(F.col("component").isNotNull(), F.concat(F.lit("#"), F.col("component"))).otherwise(F.col("address"))
    )
    df = s.save(df.select("page_id", "host", "path", "rule", "own", "alias"), "aliased")
    told = df.filter("own is not null and alias is not null").groupBy("alias").agg(
        F.max(F.when(F.col("own") == "allow", 1).otherwise(0)).alias("allowed"), F.max(F.when(F.col("own") == "block", 1).otherwise(0)).alias("blocked")
    )
    told = s.save(told, "told")
    verdict = F.expr("coalesce(own, case when coalesce(allowed, 0) = 0 and coalesce(blocked, 0) = 1 then 'block' else 'allow' end)")
    return df.join(told, "alias", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op3_redirect_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def _oracle() -> str:
    def parts(url: str, into: str) -> str:
        return ", ".join(f"coalesce({v}, '') AS {into}{k}" for k, v in _sql(url).items())

    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT page_id, url, {parts('url', '')},
  nullif(regexp_extract(html, $${CANONICAL}$$, 1), '') AS link, nullif(regexp_extract(html, $${REFRESH}$$, 1), '') AS turn FROM pages),
p AS MATERIALIZED (SELECT *, {_address('host', 'path', 'query')} AS address, {_rule_case(1)} AS rule, {_rule_case(0)} AS own FROM d),
t AS (SELECT url, unnest([link, turn]) AS target FROM p),
e AS (SELECT {_address('a_host', 'a_path', 'a_query')} AS x, {_address('b_host', 'b_path', 'b_query')} AS y
      FROM (SELECT {parts('url', 'a_')}, {parts('target', 'b_')} FROM t WHERE target IS NOT NULL)),
b AS MATERIALIZED (SELECT x, y FROM e WHERE x <> y UNION SELECT y, x FROM e WHERE x <> y),
r(address, reach) AS (SELECT x, x FROM b UNION SELECT r.address, b.y FROM r JOIN b ON r.reach = b.x),
c AS (SELECT address, min(reach) AS root FROM r GROUP BY address),
a AS MATERIALIZED (SELECT p.*, coalesce(c.root, p.address) AS alias FROM p LEFT JOIN c USING (address)),
told AS (SELECT alias, max(own = 'allow') AS allowed, max(own = 'block') AS blocked FROM a WHERE own IS NOT NULL AND alias IS NOT NULL GROUP BY alias)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN NOT coalesce(allowed, false) AND coalesce(blocked, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM a LEFT JOIN told USING (alias)
"""


ORACLE_SQL = _oracle()
