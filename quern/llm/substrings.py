"""Substring dedup by hashing units: the earliest occurrence of a passage stays, later ones are cut out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import LOWER, layout, mix, slices, stored, table, word_hashes, words
from quern.llm.decontaminate import WORD

#: Texts are cut into lines, and also by content, wherever lines end: a piece starts at the least of any WINDOW
#: word pairs in a row, so two copies of a passage are cut alike but for WINDOW words at each end.  Neighbouring
#: lines and pieces seen before are removed where they run to RUN_WORDS words: whole lines of so many, shorter
#: ones side by side, and any passage of 2 * WINDOW + RUN_WORDS words wherever it stands.  A short line that
#: repeats on its own (a heading, a licence line) stays.
WINDOW = 13
RUN_WORDS = 24

#: A digest with over one of so many repeated rows is hot (so there are fewer of them than this) and is joined in so many parts.
HOT_SHARE, HOT_PARTS = 1_000, 64

#: A bit map of the digests found twice, 8 bits a digest between these bounds, sorts out most rows that were found once.
MAP_BITS = (1 << 19, 1 << 28)
BLOCK_BITS = 1 << 15

def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each code point of a script without spaces (Thai to Tibetan, Burmese, Khmer, kana, Han)."""
    lead = np.flatnonzero((data >= 0xE0) & (data <= 0xF0))
    if not len(lead):
        return lead, lead
    a, b = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
    four = (a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)
    three = (a >= 0xE3) & (a <= 0xE9)
    for byte, lo, hi in ((0xE0, 0xB8, 0xBF), (0xE1, 0x80, 0x82), (0xE1, 0x9E, 0x9F), (0xE2, 0xBA, 0xBF), (0xEA, 0x80, 0x93), (0xEF, 0xA4, 0xAB), (0xEF, 0xBC, 0xBE)):
        three |= (a == byte) & (b >= lo) & (b <= hi)
    chosen = three | four
    return lead[chosen], (lead + 3 + four)[chosen]


def tokens(lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, but each code point of a script without spaces is a word."""
    starts, ends, firsts = words(lower, offsets, WORD)
    lead, after = _unspaced(lower)
    if not len(lead):
        return starts, ends, firsts
    inner_start, inner_end = after[~np.isin(after, ends)], lead[~np.isin(lead, starts)]
    starts = np.unique(np.concatenate([starts, lead, inner_start]))
    ends = np.unique(np.concatenate([ends, after, inner_end]))
    return starts, ends, np.searchsorted(starts, offsets)


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each `width` values in a row."""
    for k in range(width - 1):
        out = least(out[:-1], values[k + 1 :]) if k else least(values[:-1], values[1:])
    return out


def _digests(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit digest of each run of words, from their hashes and places."""
    place = (np.arange(len(hashes)) - np.repeat(begin, size)).astype(np.uint64)
    return mix(np.add.reduceat(mix(hashes ^ mix(place + np.uint64(seed))), begin) + size.astype(np.uint64))


def _edges(begin: np.ndarray, starts: np.ndarray, owner: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, and start and end in bytes, of runs of words that follow each other: from a run's first word to the next one's, a text's first run from 0 and its last to the end."""
    doc = owner[begin]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    lo = np.where(new, offsets[doc], starts[begin])
    hi = np.where(np.concatenate([new[1:], [True]]), offsets[doc + 1], np.concatenate([lo[1:], [end]]))
    return doc, lo, hi


def units(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of all texts, first the lines, then each two neighbouring pieces: document, start and end in bytes, first and last word (exclusive), two 64-bit digests.

    Digests are of words in lower case without punctuation; a piece's second digest is 0, a line's
    never is.  A text of one piece has that one alone.
    """
    data, offsets = layout(texts)
    lower = LOWER[data]
    starts, ends, firsts = tokens(lower, offsets)
    n = len(starts)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, np.uint64),) * 2
    hashes = word_hashes(lower, starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    opens = np.zeros(n, bool)
    opens[firsts[:-1][np.diff(firsts) > 0]] = True

    feeds = _running(data == 10)
    line = opens.copy()
    line[1:] |= feeds[starts[1:]] > feeds[starts[:-1]]
    begin = np.flatnonzero(line)
    size = np.diff(np.concatenate([begin, [n]]))
    doc, lo, hi = _edges(begin, starts, owner, offsets, len(data))
    one, two = _digests(hashes, begin, size, 77), _digests(hashes, begin, size, 1_234_567) | np.uint64(1)
    lines = (doc, lo - offsets[doc], hi - offsets[doc], begin - firsts[doc], begin + size - firsts[doc], one, two)

    ends_doc = np.concatenate([opens[1:], [True]])
    value = mix(hashes * np.uint64(3) + mix(np.concatenate([hashes[1:], [np.uint64(0)]])))
    value[ends_doc] = np.uint64(0xFFFFFFFFFFFFFFFF)
    cut = opens.copy()
    if n >= WINDOW:
        lows = _sliding(value, WINDOW, np.minimum)
        lows[owner[: n - WINDOW + 1] != owner[WINDOW - 1 :]] = 0  # a window of two documents
        edge = np.zeros(WINDOW - 1, np.uint64)
        chosen = np.flatnonzero((_sliding(np.concatenate([edge, lows, edge]), WINDOW, np.maximum) == value) & ~ends_doc)
        tied = np.zeros(len(chosen), bool)  # one word or two over and over make one piece
        tied[1:] = (value[chosen[1:]] == value[chosen[:-1]]) & (np.diff(chosen) <= 2)
        cut[chosen[~tied]] = True
    begin = np.flatnonzero(cut)
    size = np.diff(np.concatenate([begin, [n]]))
    digest = _digests(hashes, begin, size, 5)
    doc, lo, hi = _edges(begin, starts, owner, offsets, len(data))
    last = np.concatenate([doc[1:] != doc[:-1], [True]])
    first, until = begin - firsts[doc], begin + size - firsts[doc]
    alone = last & opens[begin]
    rows = np.flatnonzero(~last | alone)
    mate = np.where(alone, np.arange(len(begin)), np.minimum(np.arange(len(begin)) + 1, len(begin) - 1))[rows]
    both = mix(digest[rows] * np.uint64(5) + mix(np.where(alone[rows], np.uint64(1), digest[mate]) + np.uint64(9)))
    pairs = (doc[rows], (lo - offsets[doc])[rows], hi[mate] - offsets[doc[rows]], first[rows], until[mate], both, np.zeros(len(rows), np.uint64))
    return tuple(np.concatenate(x) for x in zip(lines, pairs, strict=True))


def _bit_map(digests: DataFrame) -> np.ndarray:
    """Bytes with bit `one` modulo their number of bits set for each row; at most 32 MB reach the driver."""
    bits = min(max(1 << (8 * digests.count()).bit_length(), MAP_BITS[0]), MAP_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for at in batch.column("bits"):
                block = np.zeros(BLOCK_BITS, np.uint8)
                block[np.array(at.as_py())] = 1
                packed.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], ["block", "packed"])

    slot = F.col("one").bitwiseAND(bits - 1)
    block, bit = F.shiftrightunsigned(slot, BLOCK_BITS.bit_length() - 1).cast("int"), slot.bitwiseAND(BLOCK_BITS - 1).cast("int")
    blocks = digests.select(block.alias("block"), bit.alias("bit")).groupBy("block").agg(F.collect_set("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in blocks.mapInArrow(run, "block int, packed binary").collect():
        out[row.block * (BLOCK_BITS // 8) :][: BLOCK_BITS // 8] = np.frombuffer(row.packed, np.uint8)
    return out


def _unit_rows(docs: DataFrame, known: Broadcast | None = None) -> DataFrame:
    """A row for each line and each two pieces (their `two` is 0).

    again: an earlier row of the document has the same digests.  Rows that the bit map `known` lacks are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, lo, hi, first, until, one, two = units(part.column("text"))
                key = mix(one ^ mix(doc.astype(np.uint64)))
                order = np.argsort(key, kind="stable")
                again = np.zeros(len(key), bool)
                again[order[1:]] = key[order[1:]] == key[order[:-1]]
                if known is not None:
                    slot = one & np.uint64(len(known.value) * 8 - 1)
                    kept = (known.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    doc, lo, hi, first, until, one, two, again = (x[kept] for x in (doc, lo, hi, first, until, one, two, again))
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), part.column("doc_id").take(at), part.column("hash").take(at),
                        pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                        pa.array(first.astype(np.int32)), pa.array(until.astype(np.int32)), pa.array(again),
                    ],
                    ["one", "two", "doc_id", "hash", "lo", "hi", "first_word", "until_word", "again"],
                )

    return docs.mapInArrow(run, "one long, two long, doc_id long, hash long, lo int, hi int, first_word int, until_word int, again boolean")


def spans_of(found: list[tuple[int, int, int, int]], least: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Sorted spans of a document's runs of repeated lines and pieces of at least `least` words.

    found: (lo, hi, first word, end word).  Units run on where one begins before or where the run ends.
    """
    runs: list[list[int]] = []
    for lo, hi, first, until in sorted(found):
        if runs and lo <= runs[-1][1]:
            runs[-1][1], runs[-1][3] = max(runs[-1][1], hi), max(runs[-1][3], until)
        else:
            runs.append([lo, hi, first, until])
    return [(lo, hi) for lo, hi, first, until in runs if until - first >= least]


def _spans(grouped: DataFrame, least: int) -> DataFrame:
    """doc_id, hash and spans, from found; documents without any fall away."""
    schema = "doc_id long, hash long, spans array<struct<lo:int,hi:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            flat = batch.column("found").flatten()
            rows = list(zip(*(flat.field(c).to_pylist() for c in ("lo", "hi", "first_word", "until_word")), strict=True))
            offsets = np.concatenate([[0], np.cumsum(batch.column("found").value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            spans = [spans_of(rows[a:b], least) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            some = [k for k, x in enumerate(spans) if x]
            made = pa.array([[{"lo": lo, "hi": hi} for lo, hi in spans[k]] for k in some], kind)
            at = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("hash").take(at), made], ["doc_id", "hash", "spans"])

    return grouped.mapInArrow(run, schema)


def repeats(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """doc_id, hash and the sorted spans (lo, hi in bytes of the text) of passages that occurred earlier.

    Digests meet in one aggregation with partial sums, so a line that a third of all documents
    share sends one row from each task; only digests found twice go back to the units, in a join
    that a bit map keeps small.  In it a hot digest's rows are dealt to HOT_PARTS parts.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rank = F.struct("doc_id", "hash")
    first = stored(_unit_rows(keyed).groupBy("one", "two").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        "one", "two", "n", F.col("first.doc_id").alias("first_id"), F.col("first.hash").alias("first_hash")
    ), "units")
    known = docs.sparkSession.sparkContext.broadcast(_bit_map(first))
    total = first.agg(F.sum("n").alias("total"))
    marked = stored(first.join(F.broadcast(total)).withColumn("parts", F.when(F.col("n") * HOT_SHARE > F.col("total"), HOT_PARTS).otherwise(1)).drop("n", "total"), "marked")
    hot = F.broadcast(marked.where("parts > 1").select("one", "two", "parts"))  # fewer than HOT_SHARE rows
    part = F.pmod(F.xxhash64("doc_id", "hash"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = _unit_rows(keyed, known).join(hot, ["one", "two"], "left").withColumn("part", part).drop("parts")
    firsts = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")) & ~F.col("again")
    later = dealt.join(firsts, ["one", "two", "part"]).where(~stays)
    return _spans(later.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("lo", "hi", "first_word", "until_word")).alias("found")), least)


def deduplicated(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """docs (columns doc_id, text) without passages of `least` words or more that an earlier document, or the same one, had before.

    The units are lines, hashed by their words in lower case without punctuation, and pieces cut by
    content for passages that do not fill lines.  Documents rank by doc_id, null first, then by a
    hash of the text; the first occurrence of a unit in that order stays.  Runs of later ones go.
    Added: n_bytes, n_removed, and removed, the spans cut out as byte offsets in the original text.

    Rows of equal doc_id and text count as one document and fare alike.  Null texts stay null,
    empty ones and those without a word stay as they are, an empty table stays empty; texts are
    read whole, whatever their length.  Columns of the added names are replaced.
    """
    base = docs.drop("n_bytes", "n_removed", "removed").withColumn("__quern_hash", F.xxhash64("text"))
    spans = repeats(docs, least).select(F.col("doc_id").alias("__quern_id"), F.col("hash").alias("__quern_h"), F.col("spans").alias("__quern_spans"))
    joined = base.join(spans, F.col("doc_id").eqNullSafe(F.col("__quern_id")) & (F.col("__quern_hash") == F.col("__quern_h")), "left")
    raw = F.encode("text", "UTF-8")
    edges = F.concat(F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"))), F.col("__quern_spans"))
    pieces = F.transform(edges, lambda x, k: F.substring(
        raw, x["hi"] + 1, F.coalesce(F.try_element_at(F.col("__quern_spans.lo"), k + 1), F.octet_length("text")) - x["hi"]))
    kept = F.when(F.col("__quern_spans").isNull(), F.col("text")).otherwise(
        F.decode(F.unhex(F.array_join(F.transform(pieces, F.hex), "")), "UTF-8"))
    gone = F.aggregate("__quern_spans", F.lit(0).cast("long"), lambda total, x: total + x["hi"] - x["lo"])
    removed = F.coalesce("__quern_spans", F.array().cast("array<struct<lo:int,hi:int>>"))
    return joined.select(
        *[kept.alias("text") if c == "text" else F.col(c) for c in base.columns if c != "__quern_hash"],
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(gone, F.lit(0)).alias("n_removed"), removed.alias("removed"),
    )


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
