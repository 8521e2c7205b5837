"""Cleaning of raw sale lines: every row is kept or excluded for one reason, and nothing is lost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quern.sources.stage import stored

#: The canonical fields, the codes that are no merchandise, and the date styles' patterns.
TEXT_FIELDS = ("invoice_id", "product_code", "product_name", "category", "customer_id", "region")
NUMBER_FIELDS = ("quantity", "unit_price", "revenue", "discount")
ID_FIELDS = ("invoice_id", "product_code", "customer_id")
NON_PRODUCT_CODES = ("ADJUST", "AMAZONFEE", "B", "BANK CHARGES", "C2", "CRUK", "D", "DOT", "M", "PADS", "POST", "S")
DATE_STYLES = {
    "iso": ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy-M-d'T'H:m:s"),
    "dmy": ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy H:m", "d-M-yyyy"),
    "mdy": ("M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy", "M-d-yyyy H:m", "M-d-yyyy"),
}
REASONS = ("invalid_value", "exact_duplicate", "non_product_code", "non_positive_price")


def parse_date(value: Column, style: str) -> Column:
    """The first pattern of the style that fits, else null.

    A pattern is tried only where the value has its colons and its T: a failed parse costs far more than a look.
    A plain ISO day is cast, which costs less than a pattern and reads the same.
    """
    day = value.like("____-__-__") & (value >= "0001-01-01") & F.substring(value, -1, 1).between("0", "9")
    plain = [F.when(day, value.try_cast("date").cast("timestamp").cast("timestamp_ntz"))] if "yyyy-M-d" in DATE_STYLES[style] else []
    colons = F.length(value) - F.length(F.replace(value, F.lit(":")))
    tried = [
        F.when((colons == p.count(":")) & (value.contains("T") == F.lit("T" in p)), F.try_to_timestamp(value, F.lit(p)).cast("timestamp_ntz"))
        for p in DATE_STYLES[style]
    ]
    return F.coalesce(*plain, *tried)


def parse_rate(frame: DataFrame, column: str, style: str) -> DataFrame:
    """Share of non-empty values that the style reads."""
    value = F.trim(column)
    return frame.where(value != "").agg(F.avg(parse_date(value, style).isNotNull().cast("int")).alias("rate"))


def rename(raw: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Project the mapped columns (canonical name -> own name) as text."""
    missing = sorted(set(mapping.values()) - set(raw.columns))
    if missing:
        raise KeyError(f"columns not found: {', '.join(missing)}")
    return raw.select(*[F.col(f"`{own}`").cast("string").alias(name) for name, own in mapping.items()])


def normalised(name: str) -> Column:
    """A field's text trimmed, with single spaces, ids without a trailing .0, codes in upper case, empty as null."""
    spaced = F.translate(name, "\t\n\x0b\f\r", "     ")  # patterns run only over the values that need them
    value = F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " +", " ")).otherwise(spaced))
    if name in ID_FIELDS:
        value = F.when(F.contains(spaced, F.lit(".0")), F.regexp_replace(value, r"^(\d+)\.0$", "$1")).otherwise(value)
    return F.nullif(F.upper(value) if name == "product_code" else value, F.lit(""))


def normalise(rows: DataFrame) -> DataFrame:
    return rows.select(*[normalised(c).alias(c) for c in rows.columns])


def normalised_once(rows: DataFrame, seen: Observation, texts: Sequence[str]) -> DataFrame:
    """normalise(rows), each value worked out once, while `seen` counts rows (raw) and values that change (text_<column>)."""
    both = rows.select(*rows.columns, *[normalised(c).alias(f"_n_{c}") for c in rows.columns])
    counted = both.observe(seen, F.count("*").alias("raw"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_n_{c}"))).alias(f"text_{c}") for c in texts])
    return counted.select(*[F.col(f"_n_{c}").alias(c) for c in rows.columns])


def typed(rows: DataFrame, style: str = "iso") -> DataFrame:
    """Dates and numbers; `readable` is false where a date is missing or a number that is present cannot be read."""
    readable = F.col("_date").isNotNull()
    out = rows.withColumn("_date", parse_date(F.col("occurred_at"), style))
    for name in NUMBER_FIELDS:
        if name in rows.columns:
            number = F.expr(f"try_cast(replace({name}, ',', '') as double)")
            readable = readable & (F.col(name).isNull() | F.coalesce(~F.isnan(number), F.lit(False)))
            out = out.withColumn(f"_{name}", number)
    out = out.withColumn("readable", readable).withColumn("occurred_at", F.col("_date")).drop("_date")
    for name in NUMBER_FIELDS:
        if name in rows.columns:
            out = out.withColumn(name, F.col(f"_{name}")).drop(f"_{name}")
    return out


def flagged(rows: DataFrame, non_products: Sequence[str] = NON_PRODUCT_CODES) -> DataFrame:
    """Normalised and typed rows with `reason`: null for kept rows, else the first rule that excludes them.

    Equal rows are counted with partial sums and told apart by number again: all but the first are
    duplicates, however many there are.
    """
    own = [c for c in rows.columns if c != "readable"]
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_rows"))
    each = counted.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    code = F.coalesce(F.upper("product_code").isin(list(non_products)), F.lit(False)) if "product_code" in own else F.lit(False)
    price = F.coalesce(F.col("unit_price") <= 0, F.lit(False)) if "unit_price" in own else F.lit(False)
    return each.withColumn(
        "reason",
        F.when(~F.col("readable"), "invalid_value").when(F.col("_nth") > 1, "exact_duplicate").when(code, "non_product_code").when(price, "non_positive_price"),
    ).drop("_nth", "_rows")


def reasons(rows: DataFrame) -> DataFrame:
    """Rows by reason, `kept` included: their sum is the raw count."""
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))


def quality_report(rows: DataFrame, clean_rows: DataFrame) -> DataFrame:
    """(measure, value) of a cleaned table: raw, kept and excluded rows by reason, and returns, guests, outliers and unknown names among the kept."""
    excluded = rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("measure")).agg(F.count("*").alias("value"))
    flags = {"returns": F.col("is_return"), "outliers": F.col("is_outlier"), "guests": F.col("customer_id").isNull(), "unnamed": F.col("product_name") == "UNKNOWN"}
    marked = clean_rows.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    long = marked.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in flags])).alias("x")).select("x.*")
    return excluded.union(rows.agg(F.lit("raw").alias("measure"), F.count("*").alias("value"))).union(long)


def problems(clean_rows: DataFrame) -> DataFrame:
    """(problem, rows) of a cleaned table that must be 0 before it is used."""
    rules = {
        "no date": F.col("occurred_at").isNull(), "no invoice": F.col("invoice_id").isNull(), "no price above 0": ~F.coalesce(F.col("unit_price") > 0, F.lit(False)),
        "revenue against its sign": (F.col("revenue") < 0) & ~F.col("is_return"),
    }
    counts = clean_rows.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(k).alias("rows")) for k in rules])).alias("x")).select("x.*")


#: A cleaned table needs so many rows, over so many different weeks.
LEAST_ROWS, LEAST_WEEKS = 100, 8


def sufficient(clean_rows: DataFrame, rows: int = LEAST_ROWS, weeks: int = LEAST_WEEKS) -> DataFrame:
    """(check, code, found, needed): whether a cleaned table has enough rows and weeks; code is empty where it has."""
    seen = clean_rows.agg(F.count("*").alias("n"), F.count_distinct(F.date_trunc("week", "occurred_at")).alias("w"))
    each = [F.struct(F.lit(name).alias("check"), F.when(F.col(c) >= least, "").otherwise(f"TOO_FEW_{name.upper()}").alias("code"), F.col(c).alias("found"), F.lit(least).cast("long").alias("needed"))
            for name, c, least in (("rows", "n", rows), ("weeks", "w", weeks))]
    return seen.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def with_returns(rows: DataFrame) -> DataFrame:
    """is_return: an invoice that starts with C, or a negative quantity."""
    return rows.withColumn("is_return", F.coalesce(F.upper("invoice_id").startswith("C"), F.lit(False)) | F.coalesce(F.col("quantity") < 0, F.lit(False)))


def product_names(rows: DataFrame) -> DataFrame:
    """Each code's most frequent name (ties: first in order) and its number of names."""
    counts = rows.where("product_code is not null").groupBy("product_code", "product_name").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("product_name").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("product_name").alias("name"))))
    return counts.groupBy("product_code").agg(best["name"].alias("canonical_name"), F.count("product_name").alias("variants"))


def named(rows: DataFrame) -> DataFrame:
    """product_name filled with the code's modal name, else UNKNOWN."""
    names = product_names(rows).select("product_code", "canonical_name")
    return rows.join(names, "product_code", "left").withColumn("product_name", F.coalesce("product_name", "canonical_name", F.lit("UNKNOWN"))).drop("canonical_name")


def with_revenue(rows: DataFrame) -> DataFrame:
    """revenue from quantity and price where it is absent; `revenue_differs` marks file values over 1 % off."""
    derived = F.round(F.col("quantity") * F.col("unit_price"), 2)
    given = F.col("revenue") if "revenue" in rows.columns else F.lit(None).cast("double")
    differs = F.coalesce(F.abs(given - derived) > 0.01 * F.abs(derived), F.lit(False))
    return rows.withColumn("revenue_differs", differs).withColumn("revenue", F.coalesce(given, derived))


def with_outliers(rows: DataFrame, threshold: float = 5.0, least: int = 10) -> DataFrame:
    """is_outlier: 0.6745 * |deviation| / scale over the threshold, by product over |quantity|.

    scale is the median absolute deviation, or 1.2533 times the mean one where that is 0.  Products
    of fewer than `least` rows are never flagged.  Medians come from counts of quantities by
    product, so the rows themselves are joined once and sorted nowhere.
    """
    size = F.abs(F.col("quantity"))
    counts = rows.where("product_code is not null and quantity is not null").groupBy(F.col("product_code").alias("_code"), size.alias("_q")).agg(F.count("*").alias("_k"))
    centres = counts.groupBy("_code").agg(F.percentile("_q", 0.5, F.col("_k")).alias("_m"), F.sum("_k").alias("_n"))
    away = F.abs(F.col("_q") - F.col("_m"))
    scales = counts.join(centres, "_code").groupBy("_code", "_m", "_n").agg(F.percentile(away, 0.5, F.col("_k")).alias("_mad"), (F.sum(away * F.col("_k")) / F.col("_n")).alias("_mean"))
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(1.2533 * F.col("_mean"))
    limits = scales.where(F.col("_n") >= least).select("_code", "_m", scale.alias("_scale"))
    both = rows.join(limits, F.col("product_code") == F.col("_code"), "left")
    flag = (0.6745 * F.abs(size - F.col("_m")) > threshold * F.col("_scale")) & (F.col("_scale") > 0)
    return both.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("_m", "_code", "_scale")


def last_complete(latest: Column, granularity: str) -> Column:
    """Start of the last week or month that ends on or before latest."""
    start = F.date_trunc(granularity, latest).cast("date")
    step = "INTERVAL 7 DAYS" if granularity == "week" else "INTERVAL 1 MONTH"
    ends = F.date_sub((start + F.expr(step)).cast("date"), 1)
    return F.when(latest.cast("date") >= ends, start).otherwise((start - F.expr(step)).cast("date"))


def periods(rows: DataFrame) -> DataFrame:
    span = rows.agg(F.min("occurred_at").alias("date_min"), F.max("occurred_at").alias("date_max"))
    return span.select("date_min", "date_max", last_complete(F.col("date_max"), "week").alias("last_week"), last_complete(F.col("date_max"), "month").alias("last_month"))


def closure_calendar(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """By weekday (0 Monday), and by keys where given: possible days in the span, trading days, and never / rarely (under 20 %) / open."""
    days = rows.select(*keys, F.col("occurred_at").cast("date").alias("day")).distinct()
    span = days.groupBy(*keys).agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo is not null").select(*keys, F.explode(F.sequence("lo", "hi")).alias("day"))
    return span.join(days.withColumn("open", F.lit(1)), [*keys, "day"], "left").groupBy(*keys, F.weekday("day").cast("long").alias("weekday")).agg(
        F.count("*").alias("possible"), F.coalesce(F.sum("open"), F.lit(0)).alias("traded")
    ).withColumn("verdict", F.when(F.col("traded") == 0, "never").when(F.col("traded") < 0.2 * F.col("possible"), "rarely").otherwise("open"))


def gaps(rows: DataFrame, least: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of at least `least` days without a sale, by keys where given."""
    days = rows.select(*keys, F.col("occurred_at").cast("date").alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy(*keys).orderBy("day"))
    return days.select(*keys, before.alias("after"), F.col("day").alias("until"), (F.datediff("day", before) - 1).cast("long").alias("days")).where(F.col("days") >= least)


CLEAN = (
    ("invoice_id", "string"), ("occurred_at", "timestamp_ntz"), ("product_code", "string"), ("product_name", "string"), ("category", "string"),
    ("customer_id", "string"), ("region", "string"), ("quantity", "decimal(12,3)"), ("unit_price", "decimal(12,4)"), ("revenue", "decimal(14,2)"),
    ("is_return", "boolean"), ("is_outlier", "boolean"),
)


def finalise(rows: DataFrame) -> DataFrame:
    """The twelve columns in order; missing revenue is 0, flags are never null."""
    out = []
    for name, kind in CLEAN:
        value = F.col(name) if name in rows.columns else F.lit(None)
        if name == "revenue":
            value = F.coalesce(F.round(value, 2), F.lit(0.0))
        if kind == "boolean":
            value = F.coalesce(value.cast(kind), F.lit(False))
        out.append(value.cast(kind).alias(name))
    return rows.select(*out)


def fingerprint(frame: DataFrame, version: str = "1") -> DataFrame:
    """SHA-256 of version, rows and the sum of row hashes: the order of rows does not matter."""
    total = F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)"))
    return frame.agg(F.count("*").alias("rows"), total.alias("total")).select(
        F.sha2(F.concat_ws("|", F.lit(version), F.col("rows").cast("string"), F.coalesce(F.col("total").cast("string"), F.lit("0"))), 256).alias("fingerprint"))


def judged(raw: DataFrame, mapping: Mapping[str, str], style: str = "iso") -> DataFrame:
    """Every raw row, normalised and typed, with its reason."""
    return flagged(typed(normalise(rename(raw, mapping)), style))


def clean(raw: DataFrame, mapping: Mapping[str, str], style: str = "iso") -> DataFrame:
    """The clean rows of raw: judged once and stored, then named, completed and flagged."""
    return completed(stored(judged(raw, mapping, style).where("reason is null"), "judged"))


def completed(judged_rows: DataFrame) -> DataFrame:
    """The clean rows of judged (and stored) ones."""
    kept = judged_rows.where("reason is null").drop("reason", "readable")
    return finalise(with_outliers(with_revenue(named(with_returns(kept)))))


def logged(raw: DataFrame, mapping: Mapping[str, str], style: str = "iso") -> tuple[DataFrame, DataFrame]:
    """The clean rows, stored, and (place, step, measure, rows): what each step of the cleaning touched, excluded or marked.

    Counters are taken by the passes that write the judged and the clean rows, not by passes of
    their own.  A stage that runs again after a lost executor may count twice, so where the raw
    rows counted are not the judged ones, the raw rows are counted once more.  `conserved` is 1 if
    every raw row was kept or excluded.
    """
    texts = [c for c in TEXT_FIELDS if c in mapping]
    first, second = Observation(), Observation()
    normal = normalised_once(rename(raw, mapping), first, texts)
    kinds = [F.count_if(F.coalesce("reason", F.lit("kept")) == r).alias(r) for r in ("kept", *REASONS)]
    rows = stored(flagged(typed(normal, style)).observe(second, F.count("*").alias("judged"), *kinds), "judged")
    nothing = rows.isEmpty()  # a plan over no rows drops what it observes
    seen = {"raw": 0, **{f"text_{c}": 0 for c in texts}} if nothing else first.get
    judged_rows = dict.fromkeys(("judged", "kept", *REASONS), 0) if nothing else second.get
    raw_rows = seen["raw"] if seen["raw"] == judged_rows["judged"] else raw.count()
    third = Observation()
    flags = {"is_return": F.col("is_return"), "guest": F.col("customer_id").isNull(), "unnamed": F.col("product_name") == "UNKNOWN", "is_outlier": F.col("is_outlier")}
    clean_rows = stored(completed(rows).observe(third, F.count("*").alias("clean"), *[F.count_if(c).alias(k) for k, c in flags.items()]), "clean")
    marked = third.get if judged_rows["kept"] else dict.fromkeys(("clean", *flags), 0)
    steps = [("read", "raw", raw_rows), *[("text", c, seen[f"text_{c}"]) for c in texts], *[("excluded", r, judged_rows[r]) for r in REASONS], *[("marked", k, marked[k]) for k in flags]]
    steps += [("kept", "clean", marked["clean"]), ("check", "conserved", int(raw_rows == judged_rows["judged"] and marked["clean"] == judged_rows["kept"]))]
    listed = [(k, *x) for k, x in enumerate(steps, 1)]
    return clean_rows, raw.sparkSession.createDataFrame(listed, "place long, step string, measure string, rows long")
