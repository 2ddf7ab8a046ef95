"""URL filters: host and path rules, then a blocked Bloom filter of listed URLs before an exact join, in DataFrame
operations only.

Listed URLs are brought to a canonical form and fill the blocked Bloom filter of bloom.py, of at most 2 MB. A page's canonical
URL can be listed only if the filter says "perhaps"; only such pages go on to the exact hash join with the list, which
removes the false positives. All other pages, and those that a rule decides, are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import written

#: Production rules: (host, path, verdict). A rule fits its host and all subdomains, if a path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Site names of the production list: it has every canonical URL that was seen below them with a query, as tracked links have
#: one. Other forms of such a URL are blocked by the list alone; other pages of these sites are not.
LISTED_SITES = ["ads-track", "free-bets", "cheap-pills", "casino-win", "spam-farm", "adult-x"]


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(df: DataFrame, url: str) -> DataFrame:
    """df with _host and _path; both are empty for a null or one without "://"."""
    rest = F.regexp_extract(F.col("_rest"), r"(?s)^([^/?#]*)([^?#]*)", 1), F.regexp_extract(F.col("_rest"), r"(?s)^([^/?#]*)([^?#]*)", 2)
    df = df.withColumn("_url", F.coalesce(F.col(url), F.lit(""))).withColumn("_rest", _after_scheme(F.col("_url")))
    return df.withColumn("_host", _ascii_lower(rest[0])).withColumn("_path", rest[1]).drop("_url", "_rest")


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., and path without a trailing slash or .html; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)\z", ""))


def _fits(host: str, path: str) -> Column:
    return ((F.col("_host") == host) | F.endswith(F.col("_host"), F.lit("." + host))) & F.startswith(F.col("_path"), F.lit(path))


def ruled(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df (with _host and _path) with _rule and _rule_verdict of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = _fits(host, path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return df.withColumn("_rule", rule).withColumn("_rule_verdict", verdict)


def listed_below(pages: DataFrame, sites: list[str] = LISTED_SITES) -> DataFrame:
    """The distinct canonical URLs (column canonical) of pages with a query whose host has one of the site names among its labels."""
    seen = parts(pages.select("url").where(F.rlike("url", F.lit(r"(?s)\A.*?://[^?#]*\?"))), "url")
    return seen.where(F.arrays_overlap(F.split("_host", r"\."), F.array(*map(F.lit, sites)))).select(canonical(F.col("_host"), F.col("_path")).alias("canonical")).distinct()


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages (page_id long, url string); listed has `canonical`.

    The longest rule that fits decides; without one, a page whose canonical URL is listed is blocked, and all others are
    allowed. A null url, or one without "://", has neither host nor path, fits no rule and is not listed. Repeated rows
    each get a verdict. Further columns are ignored.
    """
    listed = written(listed.select("canonical").where("canonical is not null").distinct())
    pages = ruled(parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("_page_url")), "_page_url"), rules)
    asked = F.when(F.col("_rule").isNull() & (F.col("_host") != ""), canonical(F.col("_host"), F.col("_path")))
    marked = bloom.marked(pages.withColumn("_canonical", asked), F.col("_canonical"), listed)
    out = ["page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule")]
    surely = marked.where("not _perhaps").select(*out, F.coalesce("_rule_verdict", F.lit("allow")).alias("verdict"))
    # exact: each URL that may be listed once, joined with the list
    possible = marked.where("_perhaps")
    hits = possible.select("_canonical").distinct().join(listed.hint("shuffle_hash"), F.col("_canonical") == F.col("canonical"), "left_semi").withColumn("_hit", F.lit(True))
    perhaps = possible.join(hits, "_canonical", "left").select(*out, F.when(F.col("_hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return surely.union(perhaps)


def filtered(pages: DataFrame) -> DataFrame:
    """judged() with the production rules and list."""
    return judged(pages, listed_below(pages))
