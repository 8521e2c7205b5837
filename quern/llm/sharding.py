"""Sharding: a Feistel permutation over global row numbers gives each row its shard and slot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import mix, row_key, stored, table

ROUNDS = 6


def permute(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """A permutation of 0 .. total - 1, computable for any number alone.

    A Feistel network permutes the smallest domain of 2 * half bits that holds total (under four
    times total); a result outside 0 .. total - 1 is permuted again until it falls inside.
    """
    half = np.uint64(max(1, (max(total - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS + 1))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
        return (left << half) | right

    out = once(numbers.astype(np.uint64))
    while (outside := np.flatnonzero(out >= np.uint64(total))).size:
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df, stored, with `row_number`: its place from 0 in the order of the given columns, then of a key of all columns.

    One range shuffle; places inside a partition come from the sorted rows themselves and are
    stored with them, the partitions' starts from their counts, so a rerun of a lost task cannot move them.
    """
    spark = df.sparkSession
    keyed = df.withColumn("__quern_key", row_key(*[F.col(c) for c in df.columns]))
    place = F.monotonically_increasing_id()
    placed = stored(
        keyed.repartitionByRange(*order, "__quern_key").sortWithinPartitions(*order, "__quern_key")
        .withColumn("__quern_part", F.shiftright(place, 33)).withColumn("__quern_at", place.bitwiseAND((1 << 33) - 1)).drop("__quern_key"),
        "numbered",
    )
    starts, before = [], 0
    for part, n in sorted(placed.groupBy("__quern_part").count().collect()):  # one number for each partition
        starts.append((part, before))
        before += n
    first = spark.createDataFrame(starts, "__quern_part long, __quern_start long")
    return placed.join(F.broadcast(first), "__quern_part").withColumn("row_number", F.col("__quern_start") + F.col("__quern_at")).drop("__quern_part", "__quern_at", "__quern_start")


def shard(df: DataFrame, shards: int = 24, seed: int = 7, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """df with row_number, shard and slot: a reproducible global shuffle dealt into `shards` shards.

    The permuted row number p gives shard p mod shards and slot p div shards, so the shards' row
    counts are at most one apart and slots have no gaps; permute() finds any row's place without
    the others.  Nulls sort first; equal rows are interchangeable and each gets its own slot;
    an empty table stays empty; columns of df named row_number, shard or slot are replaced.
    """
    rows = numbered(df.drop("row_number", "shard", "slot"), *order)
    total = rows.count()

    @F.pandas_udf("long")
    def permuted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(), total, seed))

    return (
        rows.withColumn("__quern_p", permuted("row_number"))
        .withColumn("shard", (F.col("__quern_p") % shards).cast("int"))
        .withColumn("slot", F.expr(f"__quern_p div {shards}")).drop("__quern_p")
    )


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
