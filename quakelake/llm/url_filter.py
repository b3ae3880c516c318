"""URL rules, with block decisions carried over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakelake.llm.common import lower_ascii, own_columns, stored, whole
from quakelake.llm.graph import connected_components
from quakelake.llm.registry import query

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
PARTS = r"://([^/?#]*)([^?#]*)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b["']?[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b["']?[^>]*>"""
HREF = r"""(?is)(?<![\w-])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
TARGET = r"""(?is)[;,\s"']url\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
#: Scheme, authority, path and query of a reference (RFC 3986, appendix B).
REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(whole(url), PARTS, 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(whole(url), PARTS, 2)


def address(url: Column) -> Column:
    """An address as a node of the alias graph: host, path and query without the fragment."""
    rest = F.regexp_extract(whole(url), r"://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def canonical_address(url: Column) -> Column:
    """The address without query, trailing slash, ``.html`` and index page: what such spellings alias."""
    short = F.regexp_replace(path_of(url), r"(?:/index)?\.html?$|/$", "")
    return F.when(url.contains("://"), F.concat(host_of(url), short))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        # The first segment is the empty one before the leading slash, which ".." never removes.
        up = F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    # A last segment of dots leaves its slash.
    ended = F.when(path.rlike(r"/\.\.?$"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(path.rlike(r"/\.\.?(/|$)"), ended).otherwise(path)


def resolved(reference: Column, base: Column) -> Column:
    """The address that a reference on the page ``base`` means (RFC 3986, 5.2); null if it is none.

    References with a scheme but no authority (``mailto:``, ``data:``) are no addresses, and none is
    read on a page without ``://``. Blanks around the reference go, ``&amp;`` is ``&``, the fragment
    is left out.
    """
    given = F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), "(?i)&amp;", "&")
    scheme, authority, path, search = (F.regexp_extract(given, REFERENCE, i) for i in range(1, 5))
    own_path, own_search = path_of(base), F.regexp_extract(base, r"://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    folder = F.when(own_path == "", F.lit("/")).otherwise(F.regexp_extract(own_path, r"(?s)^(.*/)", 1))
    merged = (
        F.when(path == "", F.concat(own_path, F.when(search == "", own_search).otherwise(search)))
        .when(path.startswith("/"), F.concat(without_dots(path), search))
        .otherwise(F.concat(without_dots(F.concat(folder, path)), search))
    )
    elsewhere = F.concat(lower_ascii(F.substr(authority, F.lit(3))), without_dots(path), search)
    return (
        F.when(~base.contains("://"), F.lit(None))
        .when(authority != "", elsewhere)
        .when(scheme == "", F.concat(host_of(base), merged))
    )


def declared_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` addresses: canonical links, refresh redirects, and the canonical spelling itself.

    Every such tag of a page counts; its target is resolved against the page's address. Null or
    empty pages declare none, and empty targets mean the page itself. Tags are read by patterns over
    the whole text, however long it is.
    """
    url, html = F.col(f"`{url_col}`"), whole(F.col(f"`{html_col}`"))

    def targets(tag: str, attribute: str) -> Column:
        tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
        named = F.filter(tags, lambda t: t.rlike(attribute))
        return F.transform(named, lambda t: F.concat(*[F.regexp_extract(t, attribute, i) for i in (1, 2, 3)]))

    found = F.concat(targets(CANONICAL, HREF), targets(REFRESH, TARGET))
    ends = F.concat(F.transform(found, lambda t: resolved(t, url)), F.array(canonical_address(url)))
    return pages.select(address(url).alias("src"), F.explode(ends).alias("dst")).filter("src <> dst")


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict), or null. Equal sizes: the larger text."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def judge_urls(
    pages: DataFrame,
    links: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every page.

    A page whose own URL fits a rule has that rule's verdict. The others take the decision of their
    alias class, the connected component of ``links (src, dst)`` that holds their address: an
    explicit allow of any member wins, else a block of any member blocks, else allow. ``rules`` is
    a list in the caller's program and becomes part of the plan.

    Null URLs and URLs without ``://`` have an empty host and path, no rule and no aliases. Repeated
    rows are judged each. An empty table gives no rows; other columns are ignored.
    """
    url = F.col(f"`{url_col}`")
    judged = (
        pages.select(F.col(f"`{id_col}`").alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("__node"))
        .withColumn("__m", matched_rule(F.col("host"), F.col("path"), rules))
        .withColumns({"rule": F.col("__m.rule"), "__own": F.col("__m.verdict")})
        .drop("__m")
    )
    nodes = stored(connected_components(links, "src", "dst"), "aliases")
    # Decisions of whole classes, also from members that no page has: their addresses fit rules too.
    node_url = F.concat(F.lit("x://"), F.col("node"))
    decided = (
        nodes.withColumn("v", matched_rule(host_of(node_url), path_of(node_url), rules)["verdict"])
        .groupBy("component")
        .agg(F.bool_or(F.col("v") == "allow").alias("a"), F.bool_or(F.col("v") == "block").alias("b"))
        .filter("b and not coalesce(a, false)")
    )
    blocked = nodes.join(decided, "component", "left_semi").select("node")
    done = judged.filter("__own is not null or __node is null")
    open_ = judged.filter("__own is null and __node is not null")
    by_alias = open_.join(blocked.withColumn("__hit", F.lit("block")), F.col("__node") == F.col("node"), "left").drop("node")
    verdict = F.coalesce("__own", "__hit", F.lit("allow"))
    return (
        done.withColumn("__hit", F.lit(None).cast("string"))
        .unionByName(by_alias)
        .select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
    )


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST_SQL = _LOWER_SQL.format(r"regexp_extract(coalesce({0}, ''), '://([^/?#]*)([^?#]*)', 1)")
_PATH_SQL = r"regexp_extract(coalesce({0}, ''), '://([^/?#]*)([^?#]*)', 2)"
_ADDRESS_SQL = "CASE WHEN contains({0}, '://') THEN " + _HOST_SQL + r" || regexp_extract({0}, '://[^/?#]*([^#]*)', 1) END"
_RULE_SQL = "max(CASE " + " ".join(
    f"WHEN rule = '{h}{p}' AND (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'n': {len(h + p)}, 'rule': rule, 'v': v}}"
    for h, p, _ in RULES
) + " END)"
OP9_SQL = f"""
WITH RECURSIVE rules(rule, v) AS (VALUES {', '.join(f"('{h}{p}', '{v}')" for h, p, v in RULES)}),
p AS (SELECT page_id, {_HOST_SQL.format('url')} AS host, {_PATH_SQL.format('url')} AS path, {_ADDRESS_SQL.format('url')} AS node,
        CASE WHEN contains(url, '://') THEN {_HOST_SQL.format('url')}
             || regexp_replace({_PATH_SQL.format('url')}, '(?:/index)?\\.html?$|/$', '') END AS clean,
        row_number() OVER () AS k FROM pages),
e AS (SELECT node AS a, clean AS b FROM p WHERE node <> clean UNION SELECT clean, node FROM p WHERE node <> clean),
reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
nodes AS (SELECT DISTINCT b AS node, {_HOST_SQL.format("'x://' || b")} AS host, {_PATH_SQL.format("'x://' || b")} AS path FROM reach),
nv AS (SELECT node, {_RULE_SQL} AS m FROM nodes CROSS JOIN rules GROUP BY node),
cls AS (SELECT a, bool_or(m.v = 'allow') AS al, bool_or(m.v = 'block') AS bl FROM reach JOIN nv ON b = node GROUP BY a),
pm AS (SELECT k, {_RULE_SQL} AS m FROM p CROSS JOIN rules GROUP BY k)
SELECT page_id, host, path, m.rule AS rule,
       coalesce(m.v, CASE WHEN bl AND NOT coalesce(al, false) THEN 'block' END, 'allow') AS verdict
FROM p JOIN pm USING (k) LEFT JOIN cls ON p.node = cls.a
"""


@query("op9_url_filter", OP9_SQL)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL, with aliases from the pages' own links."""
    pages = own_columns(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url", "html"])
    return judge_urls(pages, declared_links(pages))
