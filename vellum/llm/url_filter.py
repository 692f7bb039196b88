"""URL filter: host/path rules first, else a list of canonical URLs.

The list is turned into a blocked Bloom filter sized by the list. Rows that the filter
passes over are settled without any shuffle; possible hits alone are hash-joined
with the list, which takes out the filter's false positives. A list too long for a
filter (four million URLs) is joined with all rows, of which only ids and URLs move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.blocked_bloom import Sieve
from vellum.llm.columns import shared_folder

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The list of the query: of every site's pages in every language, numbered up to PAGES, those whose URL's MD5 begins with one of MARKS. It is a table of its own, so a page of such a site may be on it or not.
SITES = tuple(f"{name}.example.{end}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
LANGUAGES, PAGES, MARKS = ("de", "en", "es", "fr"), 10000, "01234567"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty when there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), AZ, az)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` and the last slash; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"(\.html|/)\z", ""))


def rule_for(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its verdict; nulls when none fits.

    ``rules`` is a configuration of bounded length that becomes one CASE expression.
    """
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        which, verdict = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(said)).otherwise(verdict)
    return which, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, listed, maybe_listed.

    ``listed`` has one column ``canonical``; nulls and empty ones in it are ignored,
    repeats don't matter. Null urls and urls without ``://`` have an empty host and path,
    fit no rule and are on no list, so they are allowed. Repeated rows are judged each for
    itself; an empty table gives no rows. maybe_listed is what the filter said.
    """
    folder = shared_folder(pages.sparkSession)
    listed.where("canonical is not null and canonical <> ''").select("canonical").distinct().write.parquet(f"{folder}/list")
    listed = pages.sparkSession.read.parquet(f"{folder}/list")
    sieve = Sieve(listed, F.col("canonical"))
    rows = pages.select(F.col(id_col).alias("_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.coalesce(canonical(F.col(url_col)), F.lit("")).alias("_key"))
    which, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", which.alias("rule"), said.alias("_said"), sieve.passes(F.col("_key")).alias("maybe_listed"))
    # maybe_listed is never null, so the two branches hold every row once
    sure = rows.where(~F.col("maybe_listed")).withColumn("listed", F.lit(False))
    hits = rows.where("maybe_listed").join(listed.select(F.col("canonical").alias("_key"), F.lit(True).alias("listed")), "_key", "left")
    every = sure.unionByName(hits.withColumn("listed", F.coalesce("listed", F.lit(False))))
    verdict = F.coalesce("_said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return every.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "listed", "maybe_listed")


def block_list(spark: SparkSession, sites: Sequence[str] = SITES, languages: Sequence[str] = LANGUAGES, pages: int = PAGES, marks: str = MARKS) -> DataFrame:
    """The canonical URLs of the query's list."""
    n = spark.range(1, pages + 1).select(F.col("id").cast("string").alias("n"))
    site, language = F.explode(F.array(*map(F.lit, sites))), F.explode(F.array(*map(F.lit, languages)))
    every = n.select("n", site.alias("site")).select("n", "site", language.alias("language"))
    every = every.select(F.concat_ws("/", "site", "language", "n").alias("canonical"))
    return every.where(F.substring(F.md5("canonical"), 1, 1).isin(list(marks)))
