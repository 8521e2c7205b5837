"""Frequent itemsets by vertical bitmaps: in each block of baskets an item is a row of bits, and a set the AND of its items'."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.order import numbered
from quern.sources.stage import stored

#: Baskets to a block (bits of a bitmap), rows of items multiplied at once, and candidates to a chunk.
BLOCK, ROWS, CHUNK = 4096, 256, 100_000


def bitmaps(kept: DataFrame, baskets: int, block: int = BLOCK) -> DataFrame:
    """(block, nos, bits): for each block of about `block` baskets, the numbers of the items in it, ascending, and their bitmaps.

    kept: invoice_id and no, an item's number.  Baskets go to blocks by hash; their place inside is
    where they lie in the block's order, so nothing numbers all baskets.  A large basket costs a bit
    in each of its items' rows.
    """
    parts = max(1, math.ceil(baskets / block))

    def run(rows: pa.Table) -> pa.Table:
        invoice = rows["invoice_id"].combine_chunks().dictionary_encode()
        place = invoice.indices.to_numpy()
        nos, row = np.unique(rows["no"].to_numpy(), return_inverse=True)
        bits = np.zeros((len(nos), len(invoice.dictionary)), bool)
        bits[row, place] = True
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "nos": pa.array([nos], pa.list_(pa.int64())), "bits": pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())})

    dealt = kept.select(F.pmod(F.xxhash64("invoice_id"), F.lit(parts)).cast("int").alias("block"), F.col("invoice_id").cast("string").alias("invoice_id"), "no")
    return dealt.groupBy("block").applyInArrow(run, "block int, nos array<bigint>, bits binary")


def _rows(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    nos = part.column(part.schema.get_field_index("nos"))[k].values.to_numpy()
    raw = part.column(part.schema.get_field_index("bits"))[k].as_buffer()
    return nos, np.frombuffer(raw, np.uint8).reshape(len(nos), -1)


def _pairs(blocks: DataFrame) -> DataFrame:
    """(a, b, n): how often each pair of items meets in a block: products of bit rows, a few items against all at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nos, bits = _rows(batch, k)
                wide = np.unpackbits(bits, axis=1).astype(np.float32)
                for lo in range(0, len(nos), ROWS):
                    counts = wide[lo : lo + ROWS] @ wide[lo:].T
                    i, j = np.nonzero(np.triu(counts, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(nos[lo + i]), pa.array(nos[lo + j]), pa.array(counts[i, j].astype(np.int64))], ["a", "b", "n"])

    return blocks.select("nos", "bits").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("freq")).select(F.array("a", "b").alias("nos"), "freq")


def candidates(frequent: DataFrame, length: int) -> DataFrame:
    """(nos): sets of `length` items all of whose subsets of one less are frequent: two that differ in the last item, then the other subsets."""
    head = F.slice("nos", 1, length - 2)
    left = frequent.select(head.alias("_head"), F.element_at("nos", -1).alias("_a"))
    right = left.select("_head", F.col("_a").alias("_b"))
    grown = left.join(right, "_head").where("_a < _b").select(F.concat("_head", F.array("_a", "_b")).alias("nos"))
    known = frequent.select(F.col("nos").alias("_known"))
    for k in range(length - 2):
        subset = F.concat(F.slice("nos", 1, k), F.slice("nos", k + 2, length - k - 1))
        grown = grown.join(known, subset == F.col("_known"), "left_semi")
    return grown


def counted(blocks: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(nos, freq) of candidates: chunks of them meet every block, each set is the AND of its bitmaps, and bits are counted."""
    listed = stored(numbered(wanted, [F.col("nos")], "_at").withColumn("_chunk", F.floor((F.col("_at") - 1) / CHUNK).cast("int")), "candidates")
    chunks = listed.groupBy("_chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "nos"))).alias("x")).select("_chunk", F.transform("x", lambda y: y["_at"]).alias("ids"), F.flatten(F.transform("x", lambda y: y["nos"])).alias("sets"))
    n = listed.agg(F.max("_chunk").alias("m")).first().m
    if n is None:
        return listed.select("nos", F.lit(0).cast("long").alias("freq"))
    met = blocks.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n)))).join(chunks, "_chunk").select("nos", "bits", "ids", "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                nos, bits = _rows(batch, k)
                ids, sets = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                sets = sets.reshape(-1, length)
                place = np.minimum(np.searchsorted(nos, sets), len(nos) - 1)
                here = (nos[place] == sets).all(1)
                ids, place = ids[here], place[here]
                for lo in range(0, len(ids), ROWS * 16):
                    at = place[lo : lo + ROWS * 16]
                    both = bits[at[:, 0]]
                    for c in range(1, length):
                        both = both & bits[at[:, c]]
                    n = np.bitwise_count(both).sum(1, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + ROWS * 16][n > 0]), pa.array(n[n > 0])], ["_at", "n"])

    sums = met.mapInArrow(run, "_at bigint, n bigint").groupBy("_at").agg(F.sum("n").alias("freq"))
    return listed.join(sums, "_at").select("nos", "freq")


def itemsets(items: DataFrame, min_support: float = 0.01, longest: int = 3, block: int = BLOCK) -> DataFrame:
    """(items, length, freq, baskets) of itemsets in at least ceil(min_support * baskets) baskets; items: invoice_id, item, distinct.

    Pairs are counted where they occur; longer sets are candidates first, made from frequent sets
    alone, and counted in chunks against all blocks.  No basket is taken apart into its sets, and no
    number of candidates ends the search.  Null items and invoices are left out; an empty table has no sets.
    """
    items = stored(items.where("invoice_id is not null and item is not null").select("invoice_id", "item"), "items")
    n = items.select("invoice_id").distinct().count()
    least = math.ceil(min_support * n)
    singles = items.groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    singles = stored(numbered(singles, ["item"], "no"), "level")
    blocks = stored(bitmaps(items.join(singles.select("item", "no"), "item").select("invoice_id", "no"), n, block), "bitmaps")
    names = singles.select("no", "item")
    out = singles.select(F.array("item").alias("items"), "freq")
    frequent = None
    for length in range(2, longest + 1):
        sums = _pairs(blocks) if length == 2 else counted(blocks, candidates(frequent, length), length)
        frequent = stored(sums.where(F.col("freq") >= least), "level")
        each = frequent.select("nos", "freq", F.explode("nos").alias("no")).join(names, "no")
        out = out.union(each.groupBy("nos").agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("freq").alias("freq")).select("items", "freq"))
        if frequent.isEmpty():
            break
    return out.select("items", F.size("items").cast("long").alias("length"), "freq", F.lit(n).cast("long").alias("baskets"))
