"""One-pass profile of a table: exact counts and mergeable sketches for all columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relative standard deviation of distinct counts, accuracy of quantiles (their rank's error is its reciprocal), and quantiles.
DISTINCT_ERROR, ACCURACY, SHARES = 0.02, 10_000, (0.05, 0.25, 0.5, 0.75, 0.95)


def profiled(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row a column: kind, rows, nulls, distinct, lowest and highest as text; mean, deviation and quantiles of numbers, negatives and zeros.

    One aggregation over the table, whose buffers merge across tasks and have a fixed size: rows,
    nulls, bounds, means and signs are exact; distinct counts are off by DISTINCT_ERROR (one
    standard deviation), a quantile's rank by 1 / ACCURACY.  NaN counts as a number of its own, as
    Spark orders it.  Columns of nested types have rows and nulls only.
    """
    numeric = (T.NumericType,)
    plain = (T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType, *numeric)
    chosen = [f for f in frame.schema.fields if columns is None or f.name in columns]
    parts = []
    for f in chosen:
        c, number, flat = F.col(f"`{f.name}`"), isinstance(f.dataType, numeric), isinstance(f.dataType, plain)
        none = F.lit(None).cast("double")
        x = c.cast("double")
        parts.append(F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("kind"), F.count("*").alias("rows"), F.count_if(c.isNull()).alias("nulls"),
            (F.approx_count_distinct(c, DISTINCT_ERROR) if flat else F.lit(None).cast("long")).alias("distinct"),
            (F.min(c).cast("string") if flat else F.lit(None).cast("string")).alias("lowest"), (F.max(c).cast("string") if flat else F.lit(None).cast("string")).alias("highest"),
            (F.avg(x) if number else none).alias("mean"), (F.stddev_samp(x) if number else none).alias("sd"),
            (F.percentile_approx(x, list(SHARES), ACCURACY) if number else F.lit(None).cast("array<double>")).alias("quantiles"),
            (F.count_if(x < 0) if number else F.lit(None).cast("long")).alias("negative"), (F.count_if(x == 0) if number else F.lit(None).cast("long")).alias("zero")))
    if not parts:
        raise ValueError("no column to profile")
    return frame.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def frequent(frame: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """(column, value, rows, place): the n most frequent values of each column, exactly, null among them; ties by value.

    Every column's values are counted with partial sums, so a hot value is one row a task.
    """
    long = frame.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("rows"))
    out = None
    for c in columns:
        best = counts.where(F.col("column") == c).orderBy(F.desc("rows"), F.col("value").asc_nulls_first()).limit(n)
        out = best if out is None else out.union(best)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rows")).alias("k"), "value"))), lambda x: F.struct(x["value"].alias("value"), (-x["k"]).alias("rows")))
    each = out.groupBy("column").agg(ordered.alias("x")).select("column", F.posexplode("x").alias("at", "x"))
    return each.select("column", "x.value", "x.rows", (F.col("at") + 1).cast("long").alias("place"))
