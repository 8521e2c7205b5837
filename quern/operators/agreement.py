"""Kendall's rank agreement of two columns of any length, by ranges of both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.stage import stored


def inversions(values: np.ndarray, weights: np.ndarray) -> float:
    """The weight of pairs (product of both weights) of which the earlier value is larger; values are integers from 0.

    From the highest bit down, values that agree in all higher bits keep their order, and each 0
    at a bit is preceded by the group's 1s before it.
    """
    total, order = 0.0, np.arange(len(values))
    for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
        ones = (values[order] >> bit) & 1
        group = values[order] >> (bit + 1)
        mass = np.cumsum(weights[order] * ones)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        base = np.where(first > 0, mass[first - 1], 0.0)
        before = mass - np.repeat(base, np.diff(np.append(first, len(order))))
        total += float((weights[order] * (1 - ones) * before).sum())
        order = order[np.lexsort((np.arange(len(order)), ones, group))]
    return total


def _ranged(rows: DataFrame, column: str, parts: int) -> Column:
    """The range of a column's value, cut at approximate quantiles, so equal values share one."""
    cuts = rows.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 1000).alias("c")).first().c
    return F.aggregate(F.array(*[F.lit(c) for c in sorted(set(cuts or []))]), F.lit(0), lambda n, c: n + (F.col(column) > c).cast("int")) if cuts else F.lit(0)


def kendall(frame: DataFrame, x: str | Column, y: str | Column, parts: int | None = None) -> DataFrame:
    """One row: n, concordant, discordant, ties in x, in y and in both, and tau_b; over rows with both values (NaN counts as null).

    Rows are counted by value pair first.  Discordant pairs then fall apart by ranges: those within
    a range of x are counted in its task; those of two ranges of x and one of y in the latter's;
    those of two ranges of both from the counts of cells, which are few.  A range of one value has
    no such pairs of its own and is left out, so ties gather nowhere.  Null where a column is constant.
    """
    spark = frame.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [F.col(c) if isinstance(c, str) else c for c in (x, y)]
    rows = frame.select(named[0].cast("double").alias("x"), named[1].cast("double").alias("y")).where("not isnan(x) and not isnan(y) and x is not null and y is not null")
    counts = stored(rows.groupBy("x", "y").agg(F.count("*").alias("w")), "pairs")
    both = stored(counts.withColumn("xb", _ranged(counts, "x", parts)).withColumn("yb", _ranged(counts, "y", parts)), "ranges")

    def within(first: str, second: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([first, second])
            codes = np.unique(pdf[second].to_numpy(), return_inverse=True)[1]
            return pd.DataFrame({"d": [inversions(codes, pdf["w"].to_numpy(float))]})

        return run

    def crowded(key: str, value: str) -> DataFrame:
        spread = both.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo < hi").select(key)
        return both.join(F.broadcast(spread), key)

    local = crowded("xb", "x").select("xb", "x", "y", "w").groupBy("xb").applyInPandas(within("x", "y"), "d double")
    # inside a range of y, rows of one range of x are no pairs here: they are in order of y and so are not inverted
    cross = crowded("yb", "xb").select("yb", "xb", "y", "w").groupBy("yb").applyInPandas(within("xb", "y"), "d double")
    cells = both.groupBy("xb", "yb").agg(F.sum("w").cast("double").alias("n"))
    far = cells.select(F.col("xb").alias("a"), F.col("yb").alias("b"), F.col("n").alias("m")).join(cells, (F.col("a") < F.col("xb")) & (F.col("b") > F.col("yb"))).select((F.col("m") * F.col("n")).alias("d"))
    discordant = local.union(cross).union(far).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("discordant"))
    pairs = lambda c: F.coalesce(F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2), F.lit(0.0))
    tied = lambda c, name: counts.groupBy(c).agg(F.sum("w").alias("t")).agg(pairs("t").alias(name))
    total = counts.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), pairs("w").alias("ties_both"))
    got = total.join(F.broadcast(tied("x", "ties_x"))).join(F.broadcast(tied("y", "ties_y"))).join(F.broadcast(discordant))
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    concordant = every - F.col("discordant") - F.col("ties_x") - F.col("ties_y") + F.col("ties_both")
    return got.withColumn("concordant", concordant).select(
        "n", "concordant", "discordant", "ties_x", "ties_y", "ties_both",
        F.try_divide(F.col("concordant") - F.col("discordant"), F.sqrt((every - F.col("ties_x")) * (every - F.col("ties_y")))).alias("tau_b"))
