"""URL rules by hash prefix: expand each URL, equi-join on short prefixes, then confirm the full digest.

Only DataFrame functions are used. A rule names a host and a path; it fits that host and its
subdomains where the URL's path starts with the rule's path. The longest rule that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of the short prefix that rows are joined on.
PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """``rules (host, path, verdict)`` with digests. Rules with a null or an empty host are left out; of equal rules block wins."""
    named = rules.filter("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    one = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return one.select(rule.alias("rule"), "verdict", F.sha2(rule, 256).alias("digest"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).withColumn("short", F.substring("digest", 1, PREFIX_HEX))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Host, path, rule and verdict of every row of ``pages (page_id, url, ...)``.

    * A URL that no rule fits has a null rule and the verdict ``default``; so have null and malformed URLs.
    * The longest rule wins, by characters of host and path, then of host.
    * Every distinct host and path is judged once, so a hot URL is expanded once; repeated rows all stay.
    * Only the suffix and prefix lengths that some rule has are expanded: the list of these lengths is the
      one thing read to the driver, and it holds at most (longest host) x (longest path) pairs.
    * No pages give no rows; no rules give ``default`` everywhere. Other columns are ignored.
    """
    ruled = hashed_rules(rules)
    shapes = sorted((r.labels, r.chars) for r in ruled.select("labels", "chars").distinct().collect())
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
    urls = rows.select("host", "path").filter("host <> ''").distinct()
    fits = F.filter(lengths, lambda s: (s["labels"] <= F.size(F.split("host", r"\."))) & (s["chars"] <= F.length("path")))
    grown = urls.select("host", "path", F.explode(fits).alias("s"))
    suffix = F.expr("substring_index(host, '.', -s.labels)")
    expression = F.concat(suffix, F.expr("substring(path, 1, s.chars)"))
    keyed = grown.select("host", "path", F.sha2(expression, 256).alias("full")).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    found = keyed.join(ruled.select("short", "digest", "rule", "verdict", "labels", F.length("rule").alias("chars")), "short").filter("full = digest")
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("chars", "labels", "rule")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
