"""Raw uploads: text files with their own headers, stacked sheets, provenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.stage import delete as discard_path
from quern.sources.stage import stored

#: Encodings tried in order, and the texts that count as missing.
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1")
MISSING = ("", "#N/A", "#NA", "-NaN", "-nan", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: How lines are taken apart.
OPTIONS = {"mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "escape": "\"", "nullValue": "\x00", "emptyValue": ""}
_MARK, _LAST = "\ufeff", "\ue000\uf8ff"
_BLANK = "".join(map(chr, range(1, 33)))

#: Places of headers are broadcast for up to this many files; beyond it the join shuffles, by place.
BROADCAST_FILES = 100_000


class TableError(ValueError):
    """Files that cannot be read as a table."""


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first encoding that reads every line of the files, judged in tasks over raw lines, so a stray byte anywhere counts."""
    lines = spark.read.text(path)
    seen = lines.agg(F.bool_or(~F.is_valid_utf8("value")).alias("broken"), F.bool_or(F.startswith("value", F.lit(_MARK))).alias("marked")).first()
    return ENCODINGS[2] if seen.broken else ENCODINGS[1] if seen.marked else ENCODINGS[0]


def _lines(spark: SparkSession, path: str, encoding: str | None) -> tuple[DataFrame, list[str]]:
    """(line) of the files without empty lines and without each file's header, and the names in the header.

    Headers are found by numbers only, so no pass sorts lines; the names are read from one block.
    """
    chosen = encoding or encoding_of(spark, path)
    text = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if chosen == "latin-1" else F.col("value")
    rows = spark.read.text(path).select(
        F.when(F.startswith(text, F.lit(_MARK)) | F.endswith(text, F.lit("\r")), F.regexp_replace(text, f"^{_MARK}|\r$", "")).otherwise(text).alias("line"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    ).where(F.trim("line") != "")
    blocks = rows.groupBy("file", "block").agg(F.min("row").alias("row"))
    heads = stored(blocks.groupBy("file").agg(F.min(F.struct("block", "row")).alias("head")), "heads")
    first = heads.orderBy("file").first()
    if first is None:
        raise TableError(f"no lines in {path}")
    names = rows.where((F.col("file") == first.file) & (F.col("row") == first["head"].row)).first().line
    schema = ", ".join(f"c{k} string" for k in range(names.count(",") + 2))
    fields = spark.range(1).select(F.from_csv(F.lit(names), schema, OPTIONS).alias("x")).select("x.*").first()
    tops = heads.select(F.col("head.row").alias("head"))
    if heads.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        tops = F.broadcast(tops)
    return rows.join(tops, F.col("row") == F.col("head"), "left_anti").select("line"), [c for c in fields if c is not None]


def _parsed(spark: SparkSession, path: str, encoding: str | None) -> tuple[DataFrame, list[str]]:
    """(line, x, fields): each line with its fields c0, c1, ... and how many there are, -1 for too many or an open quote.

    A line without quotes is cut at its commas.  In others a mark (of private-use code points) is
    put behind the line as one more field; where it is found tells the number.
    """
    lines, names = _lines(spark, path, encoding)
    marked = [f"c{k}" for k in range(len(names) + 1)]
    plain = ~F.contains("line", F.lit('"')) & ~F.contains("line", F.lit("\x00")) & F.is_valid_utf8("line")
    read = F.from_csv(F.concat("line", F.lit(f",{_LAST}")), ", ".join(f"{c} string" for c in marked), OPTIONS)
    # explode hands a parsed line on as a value, so that no filter or field parses it again
    whole = lines.select("line", F.explode(F.array(F.struct(F.when(plain, F.split("line", ",", -1)).alias("cut"), F.when(~plain, read).alias("read")))).alias("x"))
    place = F.coalesce(F.array_position(F.array(*[f"x.read.{c}" for c in marked]), F.lit(_LAST)), F.lit(0)) - 1
    return whole.withColumn("fields", F.when(F.col("x.cut").isNull(), place).when(F.size("x.cut") <= len(names), F.size("x.cut").cast("long")).otherwise(-1)), names


def malformed(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(line): the lines that read_text leaves out: more fields than the header has, or a quote that the line does not close."""
    return _parsed(spark, path, encoding)[0].where("fields < 0").select("line")


def read_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str | None = None) -> DataFrame:
    """A CSV file (or a folder of them) with header, every column as text; missing-value texts are null.

    A line is a row: a quoted field does not run on in the next line.  Lines of fewer fields than
    the header are filled up with nulls, those of more, or with an open quote, are left out (see
    malformed); empty lines do not count.  Reading, counting and `malformed` go by the same parsed
    lines.  Only the named columns are kept if any are named; one that is not there is an error.
    """
    rows, names = _parsed(spark, path, encoding)
    if columns and (absent := [c for c in columns if c not in names]):
        raise TableError(f"columns not in {path}: {', '.join(absent)}")
    kept = rows.where("fields >= 0")
    part = lambda k: F.get("x.cut", F.lit(k))
    field = lambda k: F.coalesce(F.when(part(k) < "!", F.ltrim(part(k), F.lit(_BLANK))).otherwise(part(k)), F.col(f"x.read.c{k}"))
    value = lambda k: F.when((F.col("fields") > k) & ~field(k).isin(list(MISSING)), field(k))
    return kept.select(*[value(names.index(c)).alias(c) for c in columns or names])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table of text columns, by the file's suffix: .csv text, or Parquet, whose values are written out as text."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix == "csv":
        return read_text(spark, path, columns)
    if suffix == "parquet":
        rows = spark.read.parquet(path)
        return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns or rows.columns])
    raise TableError(f"no reader for .{suffix}: text (.csv) and Parquet are read")


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the header, as read_text has them."""
    return _lines(spark, path, None)[1]


def weekly_series(rows: DataFrame, code: str, quantity: str, price: str, at: str, excluded: Sequence[str]) -> DataFrame:
    """(period, value): revenue by week from Monday, of text rows as read_text has them.

    A light reading for rehearsals, not the cleaning: rows need a quantity, a price above zero and
    a date, and a code that is not `excluded`.  Weeks between the first and last without rows are
    zero; a last week that the rows do not fill up to its Sunday is left out.
    """
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    used = rows.select(F.upper(F.trim(F.col(f"`{code}`"))).alias("code"), number(quantity).alias("q"), number(price).alias("p"), F.expr(f"try_cast(`{at}` as timestamp_ntz)").alias("t"))
    used = used.where((F.col("p") > 0) & F.col("q").isNotNull() & F.col("t").isNotNull() & ~F.coalesce(F.col("code").isin(list(excluded)), F.lit(False)))
    days = used.groupBy(F.date_trunc("week", "t").cast("date").alias("period")).agg(F.sum(F.col("q") * F.col("p")).alias("value"), F.max("t").cast("date").alias("last"))
    weeks = stored(days, "weeks")  # a row for each week, read twice
    span = weeks.agg(F.min("period").alias("lo"), F.max("period").alias("hi"), F.max("last").alias("last"))
    full = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("period"), "last").where(F.date_add("period", 6) <= F.col("last"))
    return full.select("period").join(weeks.select("period", "value"), "period", "left").select("period", F.coalesce("value", F.lit(0.0)).alias("value"))


def stack(sheets: Sequence[tuple[str, DataFrame]]) -> tuple[DataFrame, list[str]]:
    """Sheets with the first one's columns as one table with source_sheet, and the names of those left out."""
    names = sheets[0][1].columns
    same = [(n, s) for n, s in sheets if s.columns == names]
    whole = reduce(DataFrame.unionByName, [s.withColumn("source_sheet", F.lit(n)) for n, s in same])
    return whole, [n for n, s in sheets if s.columns != names]


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def delete_dataset(spark: SparkSession, folder: str, dataset_id: str) -> None:
    """Takes a dataset's partition out of every table of the star; the others stay."""
    for name in ("categories", "products", "customers", "sales"):
        discard_path(spark, f"{folder}/{name}/dataset_id={dataset_id}")


def write_star(clean: DataFrame, folder: str, dataset_id: str) -> None:
    """Clean lines as a star: sorted dimensions with dense ids, and a fact table; a dataset's earlier rows are replaced.

    Each dataset is a partition, so replacing one touches no other.
    """
    spark = clean.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        dims = {}
        for name, column in (("categories", "category"), ("products", "product_code"), ("customers", "customer_id")):
            values = clean.where(F.col(column).isNotNull())
            dim = values.groupBy(column).agg(F.substring(F.min("product_name"), 1, 255).alias("name")) if name == "products" else values.select(column).distinct()
            dims[column] = dim.withColumn(f"{column}_key", F.xxhash64(column))
            dims[column].withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").partitionBy("dataset_id").parquet(f"{folder}/{name}")
        facts = clean
        for column in dims:
            facts = facts.withColumn(f"{column}_key", F.when(F.col(column).isNotNull(), F.xxhash64(column))).drop(column)
        facts.drop("product_name").withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").partitionBy("dataset_id").parquet(f"{folder}/sales")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
