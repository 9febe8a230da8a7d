"""URL filters by hashed host-suffix / path-prefix expressions. DataFrame operations only.

Each distinct URL expands into the host suffixes and path prefixes whose label counts and lengths
occur in the rules. An expression meets the rules by an equi-join on the first four bytes of its
SHA-256; the full digest confirms it, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a table."""
    return spark.createDataFrame(rules, RULES)


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row's url: page_id, host, path, rule, verdict, in one row per input row.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts
    with the rule's; the longest rule (host and path together) wins, of equally long ones the
    longer host, then ``block`` over ``allow``. Without a rule: rule null, verdict ``default``.
    Null urls and urls without :// have an empty host and path and no rule. Repeated rows each get
    their row; an empty table gives an empty result; other columns are not read.

    Each distinct url is judged once, so a url that a third of the rows repeat is one key of the
    match. Only the numbers of labels and path lengths that rules use are collected: their count
    doesn't grow with the pages, and rules with hosts of 253 and paths of some thousand characters
    bound it. The rules themselves are joined, and broadcast only where Spark's size check allows.
    """
    keyed = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select("host", "path", "verdict").distinct()
    keyed = keyed.select(
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"),
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"),
    )
    shape = keyed.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_len").alias("lens")).first()
    labels, lens = sorted(shape.labels), sorted(shape.lens)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = rows.where(F.col("url").contains("://")).select("url").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.lit(labels).cast("array<int>"), lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.transform(F.filter(F.lit(lens).cast("array<int>"), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    asked = urls.select("url", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))).alias("expression"))
    asked = asked.select("url", _digest(F.col("expression")).alias("digest")).withColumn("prefix", _prefix(F.col("digest")))
    listed = keyed.withColumn("full", _digest(F.col("rule"))).withColumn("prefix", _prefix(F.col("full")))
    fits = asked.join(listed, "prefix").where(F.col("digest") == F.col("full"))
    best = fits.groupBy("url").agg(
        F.max(F.struct(F.length("rule").alias("n"), "host_len", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")).alias("best")
    )
    return rows.join(best, "url", "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query.
DEMO_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

SQL = """
WITH rules(host, path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT c.page_id, c.url, c.host, c.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM cut c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged
"""
