"""Global order without one task that holds a large column: ranges first, sums before each range after; counted small ones are sorted at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.stage import stored


#: Rows that one task sorts; more go by ranges.
SMALL = 200_000


def _name(order: str | Column) -> Column:
    return F.col(order) if isinstance(order, str) else order


def running(frame: DataFrame, order: Sequence[str | Column], value: str | Column, name: str, by: Sequence[str] = ()) -> DataFrame:
    """frame with the sum of value over all rows up to each one, in an order that has no ties (within `by`).

    The frame is stored and counted.  Up to SMALL rows are sorted in one task; beyond that come a
    range shuffle by the whole order, stored so that ranges stay what they are, a sum for each
    range, and places inside the ranges, so that only the ranges' sums meet in one task.
    """
    keys = [*[F.col(c) for c in by], *[_name(c) for c in order]]
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = stored(frame.withColumn("_order_v", F.lit(value) if not isinstance(value, (str, Column)) else _name(value)), "rows")
    if given.count() <= SMALL:
        upto = Window.partitionBy(*by).orderBy(*[_name(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        return given.withColumn(name, F.sum("_order_v").over(upto)).drop("_order_v")
    rows = stored(given.repartitionByRange(parts, *keys).withColumn("_order_part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*by, "_order_part")
    sums = rows.groupBy(*by, "_order_part").agg(F.sum("_order_v").alias("_order_s"))
    before = F.sum("_order_s").over(Window.partitionBy(*by).orderBy("_order_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*by, "_order_part", F.coalesce(before, F.lit(0)).alias("_order_b"))
    inside = F.sum("_order_v").over(whole.orderBy(*[_name(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_order_i", inside)
    if by:
        joined = joined.join(starts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_order_part").alias("_order_p"), "_order_b"), (F.col("_order_part") == F.col("_order_p")) & _all(by)).drop("_order_p", *[f"_k_{c}" for c in by])
    else:
        joined = joined.join(F.broadcast(starts), "_order_part")
    return joined.withColumn(name, F.col("_order_i") + F.col("_order_b")).drop("_order_part", "_order_v", "_order_i", "_order_b")


def _all(by: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return same


def numbered(frame: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """frame with exact row numbers, from 1, in an order that has no ties."""
    return running(frame, order, F.lit(1).cast("long"), name)


def percentiles(frame: DataFrame, value: str | Column, shares: Sequence[float], name: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """(by, name): the interpolated percentiles, as an array, of a column of any size; nulls are left out.

    Values are counted first; up to SMALL counts make one buffer, more are summed in order by ranges.
    """
    counts = stored(frame.select(*by, _name(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)").groupBy(*by, "_x").agg(F.count("*").alias("_n")), "counts")
    if counts.count() <= SMALL:
        return counts.groupBy(*by).agg(F.percentile("_x", list(shares), F.col("_n")).alias(name))
    rows = running(counts, ["_x"], "_n", "_through", by)
    size = rows.groupBy(*by).agg(F.sum("_n").alias("_all"))
    if by:
        size = size.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_all")
        rows = rows.join(size, _all(by))
    else:
        rows = rows.join(F.broadcast(size))
    parts = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("_all") - 1)
        low = F.min(F.when(F.col("_through") > F.floor(place), F.col("_x")))
        high = F.min(F.when(F.col("_through") > F.ceil(place), F.col("_x")))
        parts.append(low + (high - low) * F.max(place - F.floor(place)))
    return rows.groupBy(*by).agg(F.array(*parts).alias(name))
