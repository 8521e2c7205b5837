"""Shape of time series: calendar indices, decomposition, demand classes, anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.shape import calendar, ratio
from quern.sources.stage import stored


def calendar_index(cells: DataFrame, by: str, value: str = "gross_revenue") -> DataFrame:
    """Mean per weekday, month or hour over the overall mean; reliable from 20 cells on. cells: day, hour, value."""
    bucket = {"weekday": F.weekday("day"), "month": F.month("day"), "hour": F.col("hour")}[by].cast("long")
    overall = cells.agg(F.avg(value).alias("overall"))
    return cells.groupBy(bucket.alias("bucket")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count("*").alias("observations")).join(F.broadcast(overall)).select(
        "bucket", ratio(F.col("mean"), F.col("overall")).alias("index"), "total", "observations", (F.col("observations") >= 20).alias("reliable"))


def decompose(series: DataFrame, period: int, value: str, time: str = "period", model: str = "additive") -> DataFrame:
    """Trend (centred average), season (centred phase means) and remainder of one series of at least two cycles.

    The windows order one aggregated series, whose length is its number of periods.
    """
    series = stored(series, "series")
    order = Window.orderBy(time)
    x = F.col(value).cast("double")
    half = period // 2
    if period % 2:
        frame = order.rowsBetween(-half, half)
        trend = F.when(F.count(x).over(frame) == period, F.avg(x).over(frame))
    else:
        one, two = order.rowsBetween(-half, half - 1), order.rowsBetween(-half + 1, half)
        full = (F.count(x).over(one) == period) & (F.count(x).over(two) == period)
        trend = F.when(full, (F.avg(x).over(one) + F.avg(x).over(two)) / 2)
    rows = series.withColumn("trend", trend).withColumn("phase", ((F.row_number().over(order) - 1) % period).cast("long"))
    rows = rows.withColumn("detrended", x / F.col("trend") if model == "multiplicative" else x - F.col("trend"))
    phases = rows.groupBy("phase").agg(F.avg("detrended").alias("m"))
    centre = phases.agg(F.avg("m").alias("c"))
    seasons = phases.join(F.broadcast(centre)).select("phase", (F.col("m") / F.col("c") if model == "multiplicative" else F.col("m") - F.col("c")).alias("season"))
    joined = rows.join(F.broadcast(seasons), "phase")
    rest = x / (F.col("trend") * F.col("season")) if model == "multiplicative" else x - F.col("trend") - F.col("season")
    return joined.select(time, x.alias("value"), "phase", "trend", "season", rest.alias("remainder"))


def seasonal_strength(parts: DataFrame) -> DataFrame:
    """max(0, 1 - Var(remainder) / Var(season + remainder)) where there are three points or more."""
    rows = parts.where("remainder is not null")
    share = F.try_divide(F.var_samp("remainder"), F.var_samp(F.col("season") + F.col("remainder")))
    return rows.agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), 1 - share).alias("strength")).select(F.when(F.col("n") >= 3, F.col("strength")).alias("strength"))


def weekly_seasonality(series: DataFrame, value: str, time: str = "period", model: str = "additive") -> DataFrame:
    """Decomposition of a weekly series on the year's cycle, or on the quarter's where two years are not there; cycle says which."""
    n = series.count()  # of one aggregated series
    cycle = 52 if n >= 104 else 13
    return decompose(series, cycle, value, time, model).withColumn("cycle", F.lit(cycle).cast("long")).withColumn("weak", F.lit(n / cycle < 3))


def spectral_entropy(values: np.ndarray) -> float | None:
    """Normalised entropy of the one-sided periodogram of a demeaned series of 8 values or more; bins without power are left out."""
    x = np.asarray(values, float)
    if len(x) < 8:
        return None
    power = np.abs(np.fft.rfft(x - x.mean())) ** 2
    power[1 : len(power) - (len(x) % 2 == 0)] *= 2  # all bins but zero and Nyquist stand for two
    power = power[power > 1e-12 * max(power.max(), 1e-300)]
    if power.sum() <= 0 or len(power) < 2:
        return None
    share = power / power.sum()
    return float(-(share * np.log2(share)).sum() / np.log2(len(share)))


def demand_class(adi: Column, cv_squared: Column) -> Column:
    return F.when(adi.isNull() | cv_squared.isNull(), "unknown").when(adi < 1.32, F.when(cv_squared < 0.49, "smooth").otherwise("erratic")).otherwise(
        F.when(cv_squared < 0.49, "intermittent").otherwise("lumpy"))


#: A series of fewer periods has no profile.
LEAST_PERIODS = 26


def series_profiles(periods: DataFrame, granularity: str = "week", key: str = "product_code", value: str = "units", least: int = LEAST_PERIODS) -> DataFrame:
    """Demand profile of each series of `least` periods or more, from its first sale on, with zeros for the periods without.

    Zeros are counted from the calendar instead of being made: a series has as many periods as
    there are from its first sale to the last period of the data.
    """
    periods = stored(periods.select(key, "period", value), "periods")
    grid = calendar(periods, granularity).withColumn("place", F.row_number().over(Window.orderBy("period")))
    placed = periods.where(F.col(value) != 0).join(F.broadcast(grid), "period")
    last = grid.agg(F.max("place").alias("last"))
    sums = placed.groupBy(key).agg(F.min("place").alias("first"), F.count("*").alias("active"), F.stddev_samp(value).alias("sd"), F.avg(value).alias("mean"))
    rows = sums.join(F.broadcast(last)).withColumn("periods", (F.col("last") - F.col("first") + 1).cast("long")).where(F.col("periods") >= least)
    adi, cv2 = F.try_divide(F.col("periods"), F.col("active")), F.pow(F.try_divide(F.col("sd"), F.col("mean")), 2)
    return rows.select(key, "periods", "active", (1 - F.col("active") / F.col("periods")).alias("zero_share"), adi.alias("adi"), cv2.alias("cv_squared"), demand_class(adi, cv2).alias("class"))


def spectra(panel: DataFrame, key: str = "product_code", time: str = "period", value: str = "units") -> DataFrame:
    """Spectral entropy of each dense series."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "spectral_entropy": [spectral_entropy(pdf.sort_values(time)[value].to_numpy())]})

    return panel.select(key, time, value).groupBy(key).applyInPandas(one, f"{key} string, spectral_entropy double")


def class_table(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("class").agg(F.count("*").alias("series"), F.median("adi").alias("median_adi"), F.median("cv_squared").alias("median_cv_squared"), F.median("zero_share").alias("median_zero_share"))


def anomalies(series: DataFrame, value: str, time: str = "period", period: int = 52, threshold: float = 3.5) -> DataFrame:
    """Each period with baseline, score and flag; reason says why there are no scores.  The aggregated series is stored once.

    From 8 cycles on the baseline is a centred rolling median (an odd number of periods, a cycle
    long) and the median departure of each phase of the calendar from it, less the median of these
    departures; shorter series use a centred rolling median of up to 13 periods.  If all values are
    positive, departures are ratios and the miss is proportional.  The score is the miss's robust z.
    """
    series = stored(series.select(time, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value")), "series")
    x = F.col("value")
    size = series.agg(F.count("*").alias("n"), F.coalesce(F.min(x) > 0, F.lit(False)).alias("positive")).first()  # of one aggregated series
    n, positive = size.n, size.positive
    order = Window.orderBy(time)
    seasonal = period > 1 and n >= 8 * period
    width = period + 1 - period % 2 if seasonal else max(3, min(13, n // 3 * 2 + 1))
    frame = order.rowsBetween(-(width // 2), width // 2)
    enough = F.count("value").over(frame) >= (max(3, period // 2) if seasonal else 1)
    rows = series.withColumn("level", F.when(enough, F.percentile("value", 0.5).over(frame)))
    baseline = F.col("level")
    if seasonal:
        phase = {52: F.least(F.weekofyear(time), F.lit(52)), 12: F.month(time), 7: F.weekday(time)}.get(period, (F.row_number().over(order) - 1) % period)
        shift = F.try_divide(F.col("value"), F.col("level")) if positive else F.col("value") - F.col("level")
        rows = rows.withColumn("phase", phase.cast("long")).withColumn("shift", shift)
        rows = rows.join(F.broadcast(rows.groupBy("phase").agg(F.median("shift").alias("usual"))), "phase")
        rows = rows.join(F.broadcast(rows.agg(F.median("usual").alias("middle"))))
        if positive:
            baseline = F.col("level") * F.when(F.col("middle") != 0, F.col("usual") / F.col("middle")).otherwise(F.col("usual"))
        else:
            baseline = F.col("level") + F.col("usual") - F.col("middle")
    residual = F.col("value") - F.col("baseline")
    rows = rows.withColumn("baseline", baseline).withColumn("residual", residual).withColumn("miss", F.try_divide(F.col("value"), F.col("baseline")) - 1 if positive else residual)
    centre = rows.agg(F.median("miss").alias("centre"), F.median(F.abs("miss")).alias("usual_miss"), F.count("miss").alias("usable"), F.median("value").alias("half"), F.percentile("value", [0.25, 0.75]).alias("q"))
    rows = rows.join(F.broadcast(centre)).withColumn("dev", F.abs(F.col("miss") - F.col("centre")))
    spread = rows.agg(F.median("dev").alias("mad"), F.avg("dev").alias("mean_dev"))
    scale = F.when(F.col("mad") > 0, F.col("mad")).otherwise(1.2533 * F.col("mean_dev"))
    reference = F.col("usual_miss") if positive else F.element_at("q", 2) - F.element_at("q", 1)
    least = 1e-6 * F.greatest(reference, F.abs("half"), F.lit(1.0))
    reason = F.when((F.lit(n) < 8) | (F.col("usable") < 5), "too few periods").when(~(scale > least), "no spread")
    score = F.when(reason.isNull(), 0.6745 * F.col("dev") / scale)
    return rows.join(F.broadcast(spread)).select(
        time, "value", "baseline", "residual", score.alias("score"), F.coalesce(score > threshold, F.lit(False)).alias("flagged"),
        F.when(F.col("residual") > F.col("centre"), "above").otherwise("below").alias("direction"), reason.alias("reason"))
