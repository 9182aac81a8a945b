"""URL filters: rules by host and path, and block decisions that spread over redirects and canonical links.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest
rule (host and path together) wins, and a block wins over an allow of equal text. Urls, redirect targets and canonical
links are nodes of a graph, its edges are declared by pages (``<link rel=canonical>``, ``<meta http-equiv=refresh>``)
or by a table of redirects. Links are resolved as in browsers: against ``<base href>``, with dot segments taken out,
default ports left out, numeric and five named characters decoded. If any node of a component is blocked by a rule, every page of it that no rule decides is
blocked; a page's own allow rule is never overruled. Pages that nothing decides are allowed.

Null urls and urls without ``://`` have empty host and path, fit no rule and join no component. Every page is
returned once for each of its rows. Rules are literals of the plan; more than ``MOST_RULES`` raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import connected_components

MOST_RULES = 10_000

# The rules of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Every pattern's time grows with the page's length only: a comment or script that never ends takes the rest with it, as
# in browsers, a tag ends before the next opening bracket, and attributes are consumed one after the other.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*+>|\z)"
_TAG = r"(?i)<(?:link|meta|base)\b(?:[^<>=]++|=\s*+(?:\"[^\"<]*+\"|'[^'<]*+')?+)*+>"
_ATTRIBUTE = r"([A-Za-z-]++)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"
_REFRESH = r"(?i)\burl\s*+=\s*+['\"]?\s*+([^'\"\s]++)"
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);"
_DOTS = r"(?:\A|/)\.{1,2}(?:/|\z)"
# Named characters and default ports.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
PORTS = {"http": "80", "https": "443"}


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The winning rule as struct(size, verdict, rule), null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    if not ordered:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    found = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*found)


def without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; ``..`` at the root is left out. Time goes with the square of one path's segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    # A path that ends in a dot segment ends in a slash.
    named = F.when(last.isin(".", ".."), F.array_append(parts, F.lit(""))).otherwise(parts)
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    kept = F.aggregate(named, F.array().cast("array<string>"), lambda kept, one: F.when(one == ".", kept).when(one == "..", up(kept)).otherwise(F.array_append(kept, one)))
    return F.when(path.rlike(_DOTS), F.array_join(kept, "/")).otherwise(path)


def node_of(url: Column) -> Column:
    """The url without fragment, default port and dot segments, scheme and host in lower case; null if it has no ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), _UPPER, _LOWER)
    host = host_of(url)
    for name, port in PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(host, rf":(?:{port})?\z", "")).otherwise(host)
    query = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*[^?#]*([^#]*)", 1)
    path = without_dots(path_of(url))
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host, F.when((path == "") & (F.length(host) > 0), "/").otherwise(path), query))


def resolved(link: Column, base: Column) -> Column:
    """An absolute url for a link of a page whose links start from ``base``; null for other schemes, like ``mailto:``.

    Dot segments are still in it; ``node_of`` takes them out.
    """
    scheme = F.regexp_extract(base, r"(?s)\A(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)\A(.*/)", 1)
    query = F.regexp_extract(base, r"(?s)\A[^?#]*(\?[^#]*)?", 1)
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("#"), F.concat(root, path_of(base), query))
        .when(link.startswith("?"), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def unescaped(text: Column) -> Column:
    """``text`` with numeric and the five common named characters decoded; numbers that are no character become U+FFFD."""
    names = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))

    def decoded(name: Column) -> Column:
        hexed = F.lower(F.substring(name, 2, 1)) == "x"
        number = F.when(hexed, F.conv(F.regexp_replace(name, r"\A#[xX]", ""), 16, 10)).otherwise(F.regexp_replace(name, r"\A#", "")).try_cast("bigint")
        good = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(*(F.when(name == k, v) for k, v in NAMED.items()), point)

    plain = F.split(text, _ENTITY, -1)
    whole = F.zip_with(plain, F.transform(names, decoded), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(F.instr(text, "&") > 0, F.array_join(whole, "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes and outer spaces; null if it has none."""
    names, values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(k)) for k in (1, 2))
    value = F.get(values, (F.array_position(F.transform(names, lambda n: F.lower(n)), name) - 1).cast("int"))
    return F.btrim(value, F.lit("\"' \t\r\n\f"))


def declared_links(pages: DataFrame) -> DataFrame:
    """(source, target) urls of canonical links and refreshes; scripts, styles and comments don't count.

    Links start from the page's first ``<base href>``, itself a link of the page, else from its url.
    """
    hinted = pages.where(F.col("url").contains("://") & F.lower("html").rlike("canonical|refresh"))
    tags = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    held = hinted.select("url", tags.alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike(r"(?i)\A<base\b")), lambda t: attribute(t, "href")), lambda h: h.isNotNull())
    each = held.select("url", F.get(bases, F.lit(0)).alias("base"), F.explode("tags").alias("tag")).where(F.lower("tag").rlike("canonical|refresh"))
    tag = F.col("tag")
    link = F.when(tag.rlike(r"(?i)\A<link") & attribute(tag, "rel").rlike(r"(?i)(?:\A|\s)canonical(?:\s|\z)"), attribute(tag, "href"))
    link = link.when(tag.rlike(r"(?i)\A<meta") & (F.lower(attribute(tag, "http-equiv")) == "refresh"), F.regexp_extract(attribute(tag, "content"), _REFRESH, 1))
    found = each.select("url", node_of(F.coalesce(resolved(unescaped(F.col("base")), F.col("url")), "url")).alias("start"), unescaped(link).alias("link")).where("link <> ''")
    return found.select(F.col("url").alias("source"), resolved(F.col("link"), F.col("start")).alias("target"))


def judge_pages(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``redirects`` has source and target urls."""
    links = checkpointed(declared_links(pages))
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    edges = links.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a is not null and b is not null")
    nodes = connected_components(edges)
    seed = nodes.where(matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"] == "block")
    blocked = nodes.join(seed.select("component").distinct(), "component").select("node", F.lit("block").alias("spread"))
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    ruled = own.withColumn("won", matching_rule(F.col("host"), F.col("path"), rules))
    joined = ruled.join(blocked, "node", "left")
    return joined.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", "spread", F.lit("allow")).alias("verdict"))
