"""Robots rules and URLs: parsing of rules, and the longest prefix of a path that a rule names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of URLs that are not fetched.
RESTRICTED = ["login", "signin", "password", "private", "cart", "checkout", "captcha"]
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
_SUFFIX = r"(?i)\.(aspx|html|htm|pdf|docx|doc)$"


def url_part(url: Column, part: str) -> Column:
    """STR-15: scheme (lower case), host (lower case, without user and port) or path of a URL; empty where it is none."""
    if part == "scheme":
        return F.lower(F.regexp_extract(url, _URL, 1))
    if part == "path":
        return F.regexp_extract(url, _URL, 3)
    return F.lower(F.regexp_extract(F.regexp_extract(url, _URL, 2), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def is_public(url: Column) -> Column:
    """STR-15: http or https, a host that is not this machine or a local one, and no restricted word."""
    host, scheme = url_part(url, "host"), url_part(url, "scheme")
    outside = (F.regexp_extract(url, _URL, 2) != "") & ~host.isin("localhost", "127.0.0.1", "::1", "[::1]") & ~F.endswith(host, F.lit(".local"))
    return F.coalesce(scheme.isin("http", "https") & outside & ~F.greatest(*[F.contains(F.lower(url), F.lit(w)) for w in RESTRICTED]), F.lit(False))


def title_of(url: Column) -> Column:
    """STR-15: the last segment of the path without its suffix, marks as spaces; the URL where nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(url_part(url, "path"), "/+$", ""), "/"), -1)
    words = F.trim(F.regexp_replace(F.regexp_replace(last, _SUFFIX, ""), "-|_|%20", " "))
    return F.when(words == "", url).otherwise(words)


def rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host, ordinal, kind (allow or disallow) and prefix of the rules in `body` that hold for every agent or the named one.
    Comments go; a rule belongs to the last agent line before it; rules without a value hold nowhere."""
    lines = F.transform(F.split("body", r"\r\n|\r|\n"), lambda x: F.trim(F.split(x, "#")[0]))
    pairs = F.transform(
        F.filter(lines, lambda x: F.contains(x, F.lit(":"))),
        lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")),
    )
    each = robots.select("host", F.posexplode(pairs).alias("ordinal", "p"))
    # The last agent line at or before a rule: a maximum over the lines of one host, which is one file.
    until = Window.partitionBy("host").orderBy("ordinal")
    active = F.max(F.when(F.col("p.k") == "user-agent", F.struct("ordinal", F.col("p.v").isin("*", agent).alias("on")))).over(until)["on"]
    kept = each.withColumn("on", F.coalesce(active, F.lit(False))).where(F.col("on") & F.col("p.k").isin("allow", "disallow") & (F.col("p.v") != ""))
    return kept.select("host", "ordinal", F.col("p.k").alias("kind"), F.col("p.v").alias("prefix"))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """STR-15: pages (with url) and `allowed`: by the rule of their host with the longest prefix of their path, the first of
    equally long ones; true where none holds.

    A path is cut at the lengths that its host's rules have, and these beginnings meet the rules in an equi-join."""
    first = rules.groupBy("host", "prefix").agg(F.min(F.struct("ordinal", "kind")).alias("r"))
    sizes = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("sizes"))
    rows = pages.withColumn("host", url_part(F.col("url"), "host")).withColumn("path", F.when(url_part(F.col("url"), "path") == "", "/").otherwise(url_part(F.col("url"), "path")))
    asked = rows.select("host", "path").distinct().join(sizes, "host")
    cut = asked.select("host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n")).withColumn("prefix", F.substr("path", F.lit(1), F.col("n")))
    best = cut.join(first, ["host", "prefix"]).groupBy("host", "path").agg(F.max_by("r.kind", "n").alias("kind"))
    return rows.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce(F.col("kind") == "allow", F.lit(True))).drop("kind", "path")
