"""Spelling variants: words one insertion, deletion or replacement apart, by pairs of trie nodes.

All prefixes of a vocabulary are nodes of its trie, all suffixes nodes of the trie of its reversed
words.  With both tries numbered, leaving out one position of a word gives a pair of integers
(node before it, node after it).  Two words share such a pair exactly if they differ by a
replacement there; a word's pair without a gap equals another's with one exactly if that other
has one more code point there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import LOWER, layout, slices, stored, table, word_hashes, words

#: One run in so many loses a code point in the query; its shortest words and rarest ones, and how much more frequent a form is.
DAMAGED, LEAST_POINTS, LEAST_COUNT, RATIO = 97, 5, 3, 2

#: The CRC-32 polynomial (reflected), and the bytes of A-Z a-z.  Code points U+00C0 to U+00FF are those with the lead byte C3.
POLYNOMIAL, LEAD = 0xEDB88320, 0xC3
LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), rows >> np.uint32(1))
    return rows


_CRC = _crc_table()


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range, continued from `states`: all ranges advance a byte at a time, the long ones on their own."""
    out, size = ~states.astype(np.uint32), ends - starts
    order = np.argsort(-size, kind="stable")
    for k in order[: int(np.searchsorted(-size[order], -64, "left"))]:
        out[k] = ~np.uint32(zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(states[k])))
    order = order[int(np.searchsorted(-size[order], -64, "left")) :]
    sizes = -size[order]
    for k in range(int(size[order[0]]) if len(order) else 0):
        live = order[: int(np.searchsorted(sizes, -k, "left"))]
        out[live] = _CRC[(out[live] ^ data[starts[live] + k]) & np.uint32(0xFF)] ^ (out[live] >> np.uint32(8))
    return ~out


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of letters, and each document's first."""
    inside = LETTER[data] | (data == LEAD)
    inside[1:] |= data[:-1] == LEAD
    return words(inside.view(np.uint8), offsets, np.array([False, True] + [False] * 254))


def _counted(part: pa.RecordBatch, damaged: int, least: int) -> tuple[list[str], np.ndarray]:
    data, offsets = layout(part.column("text"))
    starts, ends, firsts = _runs(data, offsets)
    data = LOWER[data]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    ids = part.column("doc_id").cast(pa.string()).to_pylist()
    begun = np.array([zlib.crc32(f"{x}:".encode()) if x is not None else 0 for x in ids], np.uint32)
    doc = np.repeat(np.arange(len(ids)), np.diff(firsts))
    known = np.array([x is not None for x in ids])
    hit = (_crc32(data, starts, ends, begun[doc]) % np.uint32(damaged) == 0) & known[doc] if damaged else np.zeros(len(starts), bool)
    extra: list[str] = []
    crc = _crc32(data, starts[hit], ends[hit], begun[doc[hit]])
    for s, e, h in zip(starts[hit].tolist(), ends[hit].tolist(), crc.tolist(), strict=True):
        word = data[s:e].tobytes().decode()
        k = h % len(word)
        extra.append(word[:k] + word[k + 1 :])
    points = np.concatenate([[0], np.cumsum(data != LEAD)])
    whole = ~hit & (points[ends] - points[starts] >= least)
    starts, ends = starts[whole], ends[whole]
    _, at, n = np.unique(word_hashes(data, starts, ends), return_index=True, return_counts=True)
    found = [data[s:e].tobytes().decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    extra = [w for w in extra if len(w) >= least]
    return found + extra, np.concatenate([n, np.ones(len(extra), np.int64)])


def vocabulary(docs: DataFrame, damaged: int = 0, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    r"""word and n: how often each run `[A-Za-zÀ-ÿ]+` of docs (doc_id, text) occurs, A-Z lower-cased.

    With `damaged`, a run whose CRC-32 (of `<doc_id>:<run>`) it divides loses the code point at
    that number modulo its length.  Counts are summed in slices, then by Spark.  Null texts have
    no runs; runs of documents with a null doc_id stay whole; a run of any length is one word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                found, n = _counted(part, damaged, least_points)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _common(a: str, b: str) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    lo, hi = 0, most
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def trie(keys: DataFrame) -> DataFrame:
    """key and nodes: the numbers of the trie nodes that each different key passes, the root's first.

    Keys are sorted by ranges, and each range builds its part of the trie from the prefix that a
    key shares with the one before it.  A range's first key continues nodes of the ranges before:
    one row a range (its last path's length inside, and the keys at its ends) tells which numbers
    those have.  Numbers run from 0 without gaps, and a key's last node rises with the key.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(keys.repartitionByRange(parts, "key").sortWithinPartitions("key").select("key", F.spark_partition_id().alias("part")), "trie")

    def grown(frame: pd.DataFrame, stack: list[int], before: str, free: int) -> Iterator[tuple[str, list[int]]]:
        for key in frame["key"].sort_values():
            shared = _common(before, key)
            made = len(key) - shared
            stack = stack[: shared + 1] + list(range(free, free + made))
            free, before = free + made, key
            yield key, stack

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        first, last, stack = None, "", [0]
        for last, stack in grown(frame, [0], "", 1):
            first = last if first is None else first
        return pd.DataFrame([{"part": int(frame["part"].iloc[0]), "first": first, "last": last, "path": stack}])

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        """The path, key and next free number before each range, from the ranges' ends in order."""
        stack, before, free, out = [0], "", 1, []
        for r in frame.sort_values("part").itertuples():
            out.append({"part": r.part, "stack": stack, "before": before, "free": free})
            shared = _common(before, r.first)
            # a range counts its first key's nodes from its own root: those shared have numbers, the rest follow
            stack = [stack[k] if k <= shared else free + k - shared - 1 for k in map(int, r.path)]
            before, free = r.last, max(free, stack[-1] + 1)
        return pd.DataFrame(out, columns=["part", "stack", "before", "free"])

    heads = rows.groupBy("part").applyInPandas(ends, "part int, first string, last string, path array<bigint>")
    states = heads.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(joined, "part int, stack array<bigint>, before string, free bigint")

    def numbered(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        s = state.iloc[0]
        return pd.DataFrame(list(grown(own, [int(k) for k in s["stack"]], s["before"], int(s["free"]))), columns=["key", "nodes"])

    return rows.groupBy("part").cogroup(states.groupBy("part")).applyInPandas(numbered, "key string, nodes array<bigint>")


#: Kinds of rows in the pair dictionary: a word with a gap, and one without.
GAP, JOINT = 0, 1


def neighbours(counted: DataFrame) -> DataFrame:
    """word, n, n_near and the near word of largest n (ties: the smallest) as near, near_n; of different words and their counts.

    Near words differ by exactly one inserted, deleted or replaced code point.  The dictionary
    holds each word's pairs (node before, node after) with one position left out, and with none.
    Of words that share a pair with gaps there are at most as many as letters, since only the
    letter in the gap tells them apart, and at most one word has the pair without a gap: groups are
    small by nature, and a group's rows are read off against each other where they lie.  A gap in a
    row of equal letters counts as an omission for the first of them only, so no neighbour comes twice.
    """
    forward = trie(counted.select(F.col("word").alias("key")))
    backward = trie(counted.select(F.reverse("word").alias("key"))).select(F.reverse("key").alias("key"), F.col("nodes").alias("after"))
    known = stored(
        counted.join(forward.withColumnRenamed("nodes", "before"), F.col("word") == F.col("key")).drop("key")
        .join(backward, F.col("word") == F.col("key")).drop("key").withColumn("id", F.element_at("before", -1)), "spelling")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                before, after = part.column("before"), part.column("after")
                size = pc.list_value_length(before).to_numpy(zero_copy_only=False).astype(np.int64) - 1
                n, ids = part.column("n").to_numpy(), part.column("id").to_numpy()
                before, after = before.flatten().to_numpy(), after.flatten().to_numpy()
                base = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
                letters = np.frombuffer("".join(part.column("word").to_pylist()).encode("utf-32-le"), np.uint32)
                out = []
                for kind, width in ((GAP, size), (JOINT, size + 1)):
                    row = np.repeat(np.arange(len(size)), width)
                    k = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
                    left = before[base[row] + k]
                    right = after[base[row] + size[row] - k - (kind == GAP)]
                    leads = np.ones(len(row), bool)
                    if kind == GAP:
                        leads[1:] = (k[1:] == 0) | (letters[1:] != letters[:-1])
                    out.append((left, right, np.full(len(row), kind, np.int32), leads, ids[row], n[row]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["left", "right", "kind", "leads", "id", "n"])

    dictionary = known.select("word", "n", "id", "before", "after").mapInArrow(pairs, "left bigint, right bigint, kind int, leads boolean, id bigint, n bigint")
    groups = dictionary.groupBy("left", "right").agg(F.collect_list(F.struct("kind", "leads", "id", "n")).alias("members")).where(F.size("members") > 1)
    met = lambda x, y: (y["id"] != x["id"]) & F.when((x["kind"] == GAP) & (y["kind"] == GAP), True).otherwise(
        (x["kind"] != y["kind"]) & F.when(x["kind"] == GAP, x["leads"]).otherwise(y["leads"]))
    seen = F.transform("members", lambda x: F.struct(x["id"].alias("id"), F.transform(F.filter("members", lambda y: met(x, y)), lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("id"))).alias("near")))
    each = groups.select(F.explode(seen).alias("x")).select("x.id", F.size("x.near").alias("size"), F.array_max("x.near").alias("best")).where("size > 0")
    found = each.groupBy("id").agg(F.sum("size").cast("long").alias("n_near"), F.max("best").alias("best"))
    named = found.join(known.select(F.col("id").alias("near_id"), F.col("word").alias("near")), F.col("near_id") == -F.col("best.id"))
    return known.select("word", "n", "id").join(named.select("id", "n_near", "near", F.col("best.n").alias("near_n")), "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "near", "near_n")


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root: each word's frequent near word, and the last word that forms lead to.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that
    is at least `ratio` times its own n, else null; its root is the word itself then.  Counts rise
    along forms by that factor (over 1), so chains end; they are followed by doubling.  Words with
    null n have no form; repeated words are not allowed (counts are by word); an empty table stays
    empty; other columns are not read.
    """
    found = stored(neighbours(counted.select("word", "n")).withColumn("_good", F.col("near_n") >= F.lit(ratio) * F.col("n")).select(
        "word", "n", "n_near", F.when(F.col("_good"), F.col("near")).alias("form"), F.when(F.col("_good"), F.col("near_n")).alias("form_n")), "forms")
    chains = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = chains.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = stored(chains.join(step, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        chains = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    last = chains.select(F.col("word").alias("_of"), "root")
    return found.join(last, F.col("word") == F.col("_of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stored(vocabulary(table(spark, sf_dir, "documents"), DAMAGED), "vocabulary"))


OP12_SQL = rf"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) AS r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY ALL),
spelt AS (
  SELECT run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192::BIGINT + (unicode(x) >> 6), 128::BIGINT + (unicode(x) & 63)] END)) AS bytes
  FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM spelt, crc),
results AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM results WHERE length(word) >= {LEAST_POINTS} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
gaps AS (SELECT word, n, i, left(word, i::INT) AS l, substr(word, i::INT + 2) AS r FROM (SELECT *, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM gaps a JOIN vocabulary v ON v.word = a.l || a.r
  UNION SELECT v.word, a.word, a.n FROM gaps a JOIN vocabulary v ON v.word = a.l || a.r),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, min(CASE WHEN k = 1 THEN other END) AS form FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near) GROUP BY 1),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= {RATIO} * v.n THEN b.form END AS form, CASE WHEN b.m >= {RATIO} * v.n THEN b.m END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word),
chains(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chains c ON c.word = f.word JOIN formed z ON z.word = c.root AND z.form IS NULL
"""
