"""Mixing sources to target weights: weighted fair queueing in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import stored, table, word_count

KEYS = ("doc_id", "source", "size")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, repeats: int) -> DataFrame:
    """One row per source: source_size and target.

    Sources in code point order, null last, take `weights` in turn and split `share` of all sizes.
    A target stops at `repeats` times the source's size; the rest is split again by weight until no
    target is above (the water level over the sources that still have room, sorted by room per weight).
    """
    places = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("room", "place")
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per_source = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(places) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("room", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = per_source.withColumn("level", level).withColumn("open", F.col("level") <= F.col("room"))
    reached = F.min(F.when(F.col("open"), F.struct("room", "place", "level"))).over(everything)["level"]
    return levels.withColumn("reached", reached).select(
        "source", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("reached"), F.col("cap"))).alias("target"),
    )


def queue(units: DataFrame, targets: DataFrame, repeats: int, seed: int, digits: int) -> DataFrame:
    """Each copy of each unit with its virtual finish time, in (0, repeats * source_size / target].

    The shuffle order is the md5 of seed and doc_id.  Running sums do not gather a source in one
    task: sums per (source, first hex digits of the order) first, then running sums inside those.
    """
    shuffled = units.withColumn(
        "order", F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    ).withColumn("part", F.substring("order", 1, digits))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        shuffled.groupBy("source", "part").agg(F.sum("weight").alias("held"))
        .withColumn("start", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
        .select(F.col("source").alias("s_source"), F.col("part").alias("s_part"), "start")
    )
    goals = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    starts = starts.join(goals, F.col("s_source").eqNullSafe(F.col("t_source")))
    inside = Window.partitionBy("source", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    through = shuffled.withColumn("here", F.sum("weight").over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("part") == F.col("s_part"))
    ).withColumn("through", F.col("start") + F.col("here"))
    return through.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select(
        *KEYS, "rows", "weight", "order", "source_size", "target", "copy",
        F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("through")).cast("double") / F.col("target"))
        .otherwise(F.lit(0.0)).alias("finish"),
    )


def decide(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 17,
) -> DataFrame:
    """How often each (doc_id, source, size) of docs goes into a mix of `share` times all sizes.

    Each source's documents are shuffled and stamped with a virtual finish time: the source's
    running size over its target.  All stamps are put in one global order, by ranges of stamps,
    and the order is cut at the total budget; a document's second copy waits for its source's
    whole first round.  Returns doc_id, source, size, rows (equal rows of docs, which are taken
    alike), source_size, target, copies.

    Size 0 (null or empty texts) gives taken words 0; a null source is a source of its own, last in
    order; an empty table gives an empty table.
    """
    units = stored(
        docs.groupBy(*KEYS).agg(F.count("*").alias("rows")).withColumn("weight", F.col("size") * F.col("rows")), "mix"
    )
    n = units.count()
    digits = 2 if n < 5_000_000 else 3 if n < 100_000_000 else 4
    ranges = max(64, min(1 << 14, n // 20_000))
    targets = source_targets(units.select("source", F.col("weight").alias("size")), weights, share, repeats)
    stamped = queue(units, targets, repeats, seed, digits)
    # stamps spread evenly whatever a source's share: each range holds about budget / ranges words
    stamped = stored(stamped.withColumn("range", F.floor(F.col("finish") * ranges).cast("long")), "queue")
    sums = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = stamped.groupBy("range").agg(F.sum("weight").alias("held")).select(
        F.col("range").alias("r_range"), F.coalesce(F.sum("held").over(sums), F.lit(0)).alias("ahead")
    )
    budget = stamped.groupBy("source").agg(F.max("target").alias("target")).agg(F.sum("target").alias("budget"))
    order = Window.partitionBy("range").orderBy("finish", "source", "order", "doc_id", "copy", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = stamped.withColumn("inside", F.sum("weight").over(order)).join(ahead, F.col("range") == F.col("r_range")).join(F.broadcast(budget))
    return placed.groupBy(*KEYS).agg(
        F.first("rows").alias("rows"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum((F.col("ahead") + F.col("inside") <= F.col("budget")).cast("int")).alias("copies"),
    )


def mix(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: each row of docs as often as `decide` takes it, with docs' columns only."""
    sized = docs.withColumn("__quern_size", size)
    taken = decide(sized.select("doc_id", "source", F.col("__quern_size").alias("size")), **options).where("copies > 0").select(
        F.col("doc_id").alias("__quern_id"), F.col("source").alias("__quern_source"), F.col("size").alias("__quern_words"), "copies"
    )
    same = F.col("doc_id").eqNullSafe(F.col("__quern_id")) & F.col("source").eqNullSafe(F.col("__quern_source")) & (F.col("__quern_size") == F.col("__quern_words"))
    return sized.join(taken, same).withColumn("__quern_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return decide(docs).withColumn("__quern_row", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(list_filter(string_split(translate(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '), lambda w: w <> '')), 0)::BIGINT AS size
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sized GROUP BY source),
roomy AS (
  SELECT *, ([5.0, 2.0, 1.0])[(place % 3 + 1)::INT]::DOUBLE AS weight, source_size::DOUBLE * 2.0 AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM per_source),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM roomy),
reached AS (
  SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, place LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM reached), cap)) AS target FROM levels),
shuffled AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, md5('17/' || coalesce(s.doc_id::VARCHAR, 'null')) AS ord
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS through FROM shuffled),
stamped AS (
  SELECT r.*, c.copy, CASE WHEN target > 0 THEN (c.copy * source_size + through)::DOUBLE / target ELSE 0.0 END AS finish
  FROM running r CROSS JOIN (SELECT unnest([0, 1]) AS copy) c),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source ASC NULLS FIRST, ord, doc_id, copy, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM stamped)
SELECT doc_id, size, source_size, target,
       (sum(CASE WHEN used <= (SELECT sum(target) FROM targets) THEN size ELSE 0 END))::BIGINT AS taken
FROM placed GROUP BY doc_id, size, source, source_size, target
"""
