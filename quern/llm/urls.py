"""URL filters: host-suffix and path-prefix expressions against a list of rules, by short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

#: The rules of the query, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Rules are broadcast up to this many; beyond it the join shuffles.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    lower = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """Array of (host suffix, path prefix): for each (labels, length) that some rule has, the suffix of so many labels with the prefix of that length."""
    parts = F.split(host, r"\.")
    made = [
        F.when(
            (F.size(parts) >= n) & (F.char_length(path) >= k),
            F.struct(F.substring_index(host, ".", -n).alias("host"), F.substring(path, 1, k).alias("path")),
        )
        for n, k in shapes
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\x01", host, path), 256)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """urls (a column url) with host, path, rule and verdict.

    Each distinct (host, path) is expanded into host-suffix and path-prefix expressions; they meet
    the rules on the first 32 bits of their digests, full digests confirm, and the longest rule
    wins (at equal length the longer host, then block before allow).  Where no rule fits, rule is
    null and the verdict is `default`: a list of rules says nothing against other URLs.

    Null URLs and those without :// have empty host and path and fit no rule; equal URLs get equal
    verdicts; very long ones give no more expressions than short ones; an empty table stays empty,
    and without rules all verdicts are `default`.  Columns of urls named host, path, rule or
    verdict are replaced.
    """
    keyed = urls.drop("host", "path", "rule", "verdict").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = rules.select(
        F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"),
    ).withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, 8))
    shapes = ruled.select(F.size(F.split("r_host", r"\.")).alias("n"), F.char_length("r_path").alias("k")).distinct().collect()
    if not shapes:
        return keyed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    if ruled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        ruled = F.broadcast(ruled)
    places = keyed.select("host", "path").distinct()
    spread = places.withColumn("__quern_x", F.explode(expressions(F.col("host"), F.col("path"), sorted((s.n, s.k) for s in shapes)))).withColumn(
        "__quern_digest", digest(F.col("__quern_x.host"), F.col("__quern_x.path"))
    )
    met = spread.join(ruled, F.substring("__quern_digest", 1, 8) == F.col("r_short")).where(F.col("__quern_digest") == F.col("r_digest"))
    weight = F.struct(
        (F.char_length("r_host") + F.char_length("r_path")).alias("long"), F.char_length("r_host").alias("host"),
        (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    best = met.groupBy("host", "path").agg(F.max(weight).alias("__quern_best"))
    return keyed.join(best, ["host", "path"], "left").select(
        *[c for c in keyed.columns], F.col("__quern_best.rule").alias("rule"), F.coalesce(F.col("__quern_best.verdict"), F.lit(default)).alias("verdict")
    )


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH parted AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
numbered AS (SELECT *, row_number() OVER () AS n FROM parted),
fits AS (
  SELECT p.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM numbered p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM numbered p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""
