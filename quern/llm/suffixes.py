"""Suffix-array dedup by prefix-free parsing: bytes of strings that occur twice in the corpus are cut out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import layout, mix, slices, stored, table

#: Length of the strings, and of the rolling hash that picks triggers.
LENGTH = 400
TRIGGER = 64
#: Texts are parsed in pieces of so many string starts, which bounds memory for long texts.
PIECE = 2 << 20
#: Phrases of the dictionary whose suffixes are put in order together.
BLOCK = 4_000

_BITS = np.uint64(30)
_LOW = np.uint64((1 << 30) - 1)
_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses, modulo 2 ** 64."""
    global _powers
    if not _powers or len(_powers[0][0]) < n:
        _powers = []
        for base in _BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(max(n, PIECE + 2 * LENGTH), b, np.uint64)
                steps[0] = 1
                pair.append(np.cumprod(steps))
            _powers.append((pair[0], pair[1]))
    return _powers


class Digests:
    """128-bit digests of any ranges of a byte array."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for values, (up, down) in zip(_VALUES, _power_tables(len(data) + 1), strict=True):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)])
            self.sums.append((total, down))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (hi - lo).astype(np.uint64)
        return tuple(mix((total[hi] - total[lo]) * down[lo] + size) for total, down in self.sums)


def triggers(data: np.ndarray, length: int = LENGTH, width: int = TRIGGER) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of `width` bytes, and for each start of a `length`-byte string its trigger.

    The trigger is the place of the smallest rolling hash inside the string, the last of equal
    ones: it depends on the string's bytes alone, so equal strings have it at equal places, and
    every string has one.
    """
    n = len(data)
    rolling = _VALUES[0][data]
    m = 1
    while m < width:
        nxt = rolling.copy()
        nxt[: n - m] += rolling[m:] * np.uint64(pow(_BASES[0], m, 1 << 64))
        rolling, m = nxt, 2 * m
    rolling = mix(rolling)
    span = length - width + 1
    packed = (rolling & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    full = -(-n // span) * span
    blocks = np.concatenate([packed, np.full(full - n, np.iinfo(np.uint64).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    return rolling, (_LOW - (least & _LOW)).astype(np.int64)


def parse(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, width: int = TRIGGER) -> dict[str, np.ndarray]:
    """Phrases of each text: a maximal run of string starts with one trigger, and its bytes up to the last string's end.

    doc, lo and hi (first and last string start), one (last start of the first phrase of a row),
    times, trigger, and the phrase's two digests.  A phrase that follows itself makes one row.
    """
    sizes = np.diff(offsets)
    if not len(data) or sizes.max() < length:
        return {k: np.zeros(0, np.uint64 if k in ("trigger", "p1", "p2") else np.int64) for k in ("doc", "lo", "hi", "one", "times", "trigger", "p1", "p2")}
    rolling, place = triggers(data, length, width)
    inside = np.zeros(len(data) + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(inside)[: len(place)] > 0
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    end = valid.copy()
    end[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    lo, hi = np.flatnonzero(begin), np.flatnonzero(end)
    p1, p2 = Digests(data).of(lo, hi + length)
    doc = np.searchsorted(offsets, lo, "right") - 1
    new = np.ones(len(lo), bool)
    new[1:] = (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != hi[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(lo)]]) - 1
    return {
        "doc": doc[first], "lo": lo[first], "hi": hi[last], "one": hi[first], "times": last - first + 1,
        "trigger": rolling[place[lo[first]]], "p1": p1[first], "p2": p2[first],
    }


_PHRASE = "trigger long, p1 long, p2 long, doc_id long, hash long, lo long, hi long, one long, times long"


def _parsed(docs: DataFrame, length: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PHRASE.split(", ")]
        for batch in batches:
            for part in slices(batch, limit=PIECE):
                data, offsets = layout(part.column("text"))
                pieces = [(data, offsets, 0)]
                if part.num_rows == 1 and len(data) > PIECE:
                    cuts = [(data[c : c + PIECE + length - 1], c) for c in range(0, len(data) - length + 1, PIECE)]
                    pieces = [(x, np.array([0, len(x)]), c) for x, c in cuts]
                for own, at, base in pieces:
                    got = parse(own, at, length, width)
                    shift = base - at[:-1][got["doc"]]
                    row = pa.array(got["doc"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[pa.array(got[k].view(np.int64)) for k in ("trigger", "p1", "p2")], part.column("doc_id").take(row), part.column("hash").take(row),
                            *[pa.array(got[k] + shift) for k in ("lo", "hi", "one")], pa.array(got["times"]),
                        ],
                        names,
                    )

    return docs.mapInArrow(run, _PHRASE)


def _sliced(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted phrases, cut from the documents that hold them."""
    held = wanted.select(F.col("doc_id").alias("__quern_id"), F.col("hash").alias("__quern_hash"), "trigger", "p1", "p2", "phrases", "lo", "one")
    same = F.col("doc_id").eqNullSafe(F.col("__quern_id")) & (F.col("hash") == F.col("__quern_hash"))
    spot = held.groupBy("__quern_id", "__quern_hash").agg(F.collect_list(F.struct("trigger", "p1", "p2", "phrases", "lo", "one")).alias("at"))
    raw = F.encode("text", "UTF-8")
    return docs.join(spot, same).select(raw.alias("raw"), F.explode("at").alias("at")).select(
        "at.trigger", "at.p1", "at.p2", "at.phrases", F.substring(F.col("raw"), (F.col("at.lo") + 1).cast("int"), (F.col("at.one") - F.col("at.lo") + length).cast("int")).alias("bytes")
    )


def _phrases(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The wanted phrases, once each: rows repeated as a whole give theirs once a row, and only then are they shuffled and thinned."""
    wanted = stored(wanted, "wanted")
    phrases = stored(_sliced(docs, wanted, length), "phrases")
    if phrases.count() == wanted.count():
        return phrases
    return stored(phrases.dropDuplicates(["p1", "p2"]), "phrases")


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix of data in the order of its first `length` bytes; suffixes equal that far share one.

    A suffix array by prefix doubling: ranks by 8 bytes are refined to 16, 32 and so on by the rank
    of the suffix that starts where the known bytes end.  A suffix that is alone with its rank
    keeps it, so each round sorts only what is still tied.  A rank is the place of its first
    suffix in the order, and suffixes past the end read zeros.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    known = min(8, length)
    key = np.zeros(n, np.uint64)
    for k in range(known):
        key = (key << np.uint64(8)) | padded[k : k + n]
    rank = np.zeros(n + length, np.int64)
    tied, first = np.argsort(key, kind="stable"), np.zeros(n, np.int64)
    key = key[tied]
    while True:
        # tied: suffixes whose rank (first) is shared, in its order; key: what tells them apart now
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1])
        group = np.ones(len(tied), bool)
        group[1:] = first[1:] != first[:-1]
        at = np.arange(len(tied))
        start, base = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(group, at, 0))
        first = first + start - base
        rank[tied] = first
        alone = new & np.append(new[1:], True)
        tied, first = tied[~alone], first[~alone]
        if known == length or not len(tied):
            return rank[:n]
        step = min(known, length - known)  # so many bytes more: what the suffix `step` further knows
        both = (first << 32) | rank[tied + step]
        order = np.argsort(both)
        tied, first, key = tied[order], first[order], both[order]
        known += step


_FOUND = "p1 long, p2 long, first long, last long, d1 long, d2 long"


def _dictionary_order(phrases: DataFrame, length: int, block: int) -> DataFrame:
    """Suffix order of the dictionary, block by block of whole phrases.

    Rows with first and last are runs of string starts of a phrase whose neighbour in the block's
    suffix order is equal for `length` bytes.  Blocks hold whole triggers; only a trigger of more
    phrases than a block takes several, and its blocks also give one row with digests for each
    string that none before it in their order equals, by which the orders are merged.
    """

    def run(group: pa.Table) -> pa.Table:
        p1, p2 = group.column("p1").to_numpy(), group.column("p2").to_numpy()
        spread = group.column("spread").to_numpy(zero_copy_only=False).astype(bool)
        blobs = group.column("bytes").to_pylist()
        sizes = np.array([len(b) for b in blobs])
        data, offsets = np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, offsets[:-1], 1)
        np.add.at(inside, offsets[:-1] + np.maximum(sizes - length + 1, 0), -1)
        starts = np.flatnonzero(np.cumsum(inside)[: len(data)] > 0)
        owner = np.searchsorted(offsets, starts, "right") - 1
        rank = suffix_ranks(data, length)[starts]
        order = np.argsort(rank, kind="stable")
        equal = rank[order[1:]] == rank[order[:-1]]  # neighbours whose common prefix is `length` or more
        twice = np.zeros(len(order), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        own, at = owner[twice], (starts - offsets[owner])[twice]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(own)]]) - 1 if len(head) else head
        leads = np.ones(len(order), bool)
        leads[1:] = ~equal
        lead = order[leads]
        lead = lead[spread[owner[lead]]]
        d1, d2 = Digests(data).of(starts[lead], starts[lead] + length) if len(lead) else (np.zeros(0, np.uint64),) * 2
        place = (starts - offsets[owner])[lead]
        none = [None] * len(head)
        return pa.table({
            "p1": pa.array(np.concatenate([p1[own[head]], p1[owner[lead]]])), "p2": pa.array(np.concatenate([p2[own[head]], p2[owner[lead]]])),
            "first": pa.array(np.concatenate([at[head], place])), "last": pa.array(np.concatenate([at[tail], place])),
            "d1": pa.array([*none, *d1.view(np.int64).tolist()], pa.int64()), "d2": pa.array([*none, *d2.view(np.int64).tolist()], pa.int64()),
        })

    blocks = max(1, phrases.count() // block)
    spread = F.col("phrases") > block
    salt = F.when(spread, F.pmod("p1", F.ceil(F.col("phrases") / block))).otherwise(F.lit(0))
    dealt = phrases.select("p1", "p2", "bytes", spread.alias("spread"), F.pmod("trigger", F.lit(blocks)).alias("block"), salt.cast("long").alias("salt"))
    found = stored(dealt.groupBy("block", "salt").applyInArrow(run, _FOUND), "order")
    merged = found.where("d1 is not null")
    twice = merged.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return found.where("d1 is null").select("p1", "p2", "first", "last").union(merged.join(twice, ["d1", "d2"]).select("p1", "p2", "first", "last"))


CUT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))),
])


def repeated(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER, block: int = BLOCK) -> DataFrame:
    """doc_id, hash and spans (lo, hi in bytes, unsorted) that strings found twice cover; docs has doc_id, hash, text.

    Texts are parsed into phrases at triggers of a rolling hash; phrases overlap so far that each
    string lies in one.  The dictionary holds each phrase once, with its number of occurrences in
    all parses.  Corpus order is the order of the dictionary's suffixes, and under each of them
    that of the parses: a string is found twice if its phrase occurs twice in the parses, or if
    the suffix order of the dictionary puts an equal string next to it.  Equal strings have equal
    triggers, so only triggers with several phrases need that order, and blocks of whole triggers
    can be put in order apart.
    """
    parses = stored(_parsed(docs, length, width), "parses")
    dictionary = stored(
        parses.groupBy("trigger", "p1", "p2").agg(
            F.sum("times").alias("n"), F.min(F.struct("doc_id", "hash", "lo", "one")).alias("at")
        ), "dictionary",
    )
    shared = dictionary.groupBy("trigger").agg(F.count("*").alias("phrases")).where("phrases > 1")
    wanted = dictionary.join(shared, "trigger").select("trigger", "p1", "p2", "phrases", "at.*")
    found = _dictionary_order(_phrases(docs, wanted, length), length, block)
    inside = found.groupBy("p1", "p2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))  # runs of one phrase
    whole = dictionary.where("n > 1").select("p1", "p2", F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("runs"))
    partly = inside.join(dictionary.where("n = 1").select("p1", "p2"), ["p1", "p2"])
    covered = whole.union(partly.select("p1", "p2", "runs"))
    spans = F.when(F.col("runs").isNull(), F.array(F.struct(F.col("lo").alias("lo"), (F.col("hi") + length).alias("hi")))).otherwise(
        F.transform("runs", lambda r: F.struct((F.col("lo") + r["first"]).alias("lo"), (F.col("lo") + r["last"] + length).alias("hi")))
    )
    marked = parses.select("p1", "p2", "doc_id", "hash", "lo", "hi").join(covered, ["p1", "p2"]).select("doc_id", "hash", F.explode(spans).alias("span"))
    # a set: rows repeated as a whole have their spans once, however many they are
    return marked.groupBy("doc_id", "hash").agg(F.collect_set("span").alias("spans"))


def cut(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER, block: int = BLOCK) -> DataFrame:
    """docs (columns doc_id, text) with n_bytes, n_removed, n_spans, kept_sha256, kept and removed.

    Each byte of a text's UTF-8 form goes that a `length`-byte string covers which also starts
    anywhere else, in the same text or another one.  kept is the remaining bytes, removed the
    maximal runs cut out, as offsets in the original.  Strings are compared by 128-bit digests.

    Null texts count as empty, shorter ones lose nothing, repeated rows are copies of each other;
    columns of docs of these names are replaced.
    """
    base = docs.drop(*CUT.fieldNames()).withColumn("__quern_hash", F.xxhash64("text"))
    keyed = base.select("doc_id", F.col("__quern_hash").alias("hash"), "text")
    spans = repeated(keyed, length, width, block).select(F.col("doc_id").alias("__quern_id"), F.col("hash").alias("__quern_h"), F.col("spans").alias("__quern_spans"))
    joined = base.join(spans, F.col("doc_id").eqNullSafe(F.col("__quern_id")) & (F.col("__quern_hash") == F.col("__quern_h")), "left").drop("__quern_id", "__quern_h", "__quern_hash")
    own = [f for f in joined.schema.fields if f.name != "__quern_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))]
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                data, offsets = layout(part.column("text"))
                raw = data.tobytes()
                for k, found in enumerate(part.column("__quern_spans").to_pylist()):
                    text = raw[offsets[k] : offsets[k + 1]]
                    runs: list[list[int]] = []
                    for lo, hi in sorted((s["lo"], s["hi"]) for s in found or ()):
                        if runs and lo <= runs[-1][1]:
                            runs[-1][1] = max(hi, runs[-1][1])
                        else:
                            runs.append([lo, hi])
                    kept, place = [], 0
                    for lo, hi in runs:
                        kept.append(text[place:lo])
                        place = hi
                    rest = b"".join([*kept, text[place:]])
                    rows.append((len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest, [{"lo": a, "hi": b} for a, b in runs]))
                added = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in own], *added], [*[f.name for f in own], *CUT.fieldNames()])

    return joined.mapInArrow(run, T.StructType([*own, *CUT.fields]))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP8_SQL = r"""WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, k, md5(substr(h, 2 * k + 1, 800)) AS d FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS k FROM hexed WHERE length(h) >= 800)),
twice AS (SELECT d FROM strings GROUP BY d HAVING count(*) > 1),
starts AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 400 THEN 0 ELSE 1 END AS new FROM strings WHERE d IN (SELECT d FROM twice)),
spans AS (SELECT doc_id, min(k) AS lo, max(k) + 400 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM starts) GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM spans
  UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, NULL FROM hexed WHERE doc_id NOT IN (SELECT doc_id FROM spans)),
kept AS (
  SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS rest FROM gaps g JOIN hexed x ON x.doc_id = g.doc_id GROUP BY 1),
sums AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS c FROM spans GROUP BY 1)
SELECT h.doc_id, (length(h.h) // 2)::BIGINT AS n_bytes, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.c, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.rest, ''))) AS kept_sha256
FROM hexed h JOIN kept k ON k.doc_id = h.doc_id LEFT JOIN sums s ON s.doc_id = h.doc_id
"""
