"""Benchmark decontamination: training tokens stream through a suffix automaton of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import LOWER, layout, mix, slices, stored, table, word_hashes, words

_ODD = np.uint64(0x9E3779B97F4A7C15)

WINDOW = 10
#: Words by which items and documents are sifted and brought together; shorter items are taken whole.
GRAM = 5
#: Windows that begin in one piece of an item, words of items in an automaton (on average), and words that a task streams through it.
PIECE_WORDS = 2_000
BLOCK_WORDS = 100_000
PART_WORDS = 1_000_000
#: The sieve that every task gets has between 2**16 and 2**27 bits (16 MB), however many items there are.
LEAST_BITS, MOST_BITS = 16, 27
#: Bytes of the sieve that one task sets.
PAGE = 1 << 16
#: A document with a larger percentage of its words hit goes as a whole.
MAX_COVERAGE = 50

#: Bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("rest", T.StringType()),
])


def _places(texts: pa.Array) -> tuple[np.ndarray, ...]:
    data, offsets = layout(texts)
    return data, offsets, *words(LOWER[data], offsets, WORD)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, ...]:
    data, offsets, starts, ends, firsts = _places(texts)
    return data, offsets, starts, ends, firsts, word_hashes(LOWER[data], starts, ends)


@dataclass
class Automaton:
    """A generalised suffix automaton over the items' words, with what a match at each state implies."""

    vocabulary: np.ndarray
    steps: list[dict[int, int]]
    link: list[int]
    length: list[int]
    window: list[int]
    holders: dict[int, tuple[str, ...]]
    whole: dict[int, list[tuple[int, str]]]
    next_whole: list[int]


def build(items: list[tuple[str, np.ndarray]], width: int) -> Automaton:
    """items: id and word hashes of each, with at least one word."""
    vocabulary = np.unique(np.concatenate([h for _, h in items]))
    coded = [(name, np.searchsorted(vocabulary, h)) for name, h in items]
    steps, link, length = [{}], [-1], [0]
    ends: list[tuple[int, str, int, int]] = []
    for name, codes in coded:
        last = 0
        for k, c in enumerate(codes.tolist()):
            if c in steps[last]:
                q = steps[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = _split(steps, link, length, last, c, q)
            else:
                new = len(steps)
                steps.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in steps[p]:
                    steps[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = steps[p][c]
                    link[new] = q if length[q] == length[p] + 1 else _split(steps, link, length, p, c, q)
                last = new
            ends.append((last, name, k + 1, len(codes)))
    # holders of each state's strings: an item holds what its prefixes' states, and those below them, stand for
    by_length = sorted(range(1, len(steps)), key=length.__getitem__)
    window = [0] * len(steps)
    for v in by_length:
        if length[v] >= width:
            window[v] = v if length[link[v]] < width else window[link[v]]
    holders: dict[int, set[str]] = {}
    whole: dict[int, list[tuple[int, str]]] = {}
    for state, name, k, n in ends:
        if k >= width:
            holders.setdefault(window[state], set()).add(name)
        if n < width and k == n:
            whole.setdefault(state, []).append((n, name))
    next_whole = [0] * len(steps)
    for v in by_length:
        next_whole[v] = link[v] if link[v] in whole else next_whole[link[v]] if link[v] > 0 else 0
    return Automaton(vocabulary, steps, link, length, window, {k: tuple(sorted(v)) for k, v in holders.items()}, whole, next_whole)


def _split(steps: list[dict[int, int]], link: list[int], length: list[int], p: int, c: int, q: int) -> int:
    clone = len(steps)
    steps.append(dict(steps[q]))
    link.append(link[q])
    length.append(length[p] + 1)
    link[q] = clone
    while p >= 0 and steps[p].get(c) == q:
        steps[p][c] = clone
        p = link[p]
    return clone


def _stream(a: Automaton, codes: list[int], base: int, width: int, hits: list[tuple[int, int]], names: set[str]) -> None:
    steps, link, length = a.steps, a.link, a.length
    v = m = 0
    for k, c in enumerate(codes):
        while v and c not in steps[v]:
            v = link[v]
            m = length[v]
        v = steps[v].get(c, 0)
        m = m + 1 if v else 0
        if m >= width:
            hits.append((base + k - m + 1, base + k + 1))
            names.update(a.holders[a.window[v]])
        u = v if v in a.whole else a.next_whole[v]
        while u:
            for n, name in a.whole[u]:
                if n <= m:
                    hits.append((base + k - n + 1, base + k + 1))
                    names.add(name)
            u = a.next_whole[u]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _grams(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the n words from each place on, and whether they belong to one text."""
    out = np.full(len(hashes), n, np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        out = out * _ODD + padded[k : k + len(hashes)]
    inside = np.ones(len(hashes), bool)
    for k in range(1, n):
        late = firsts[1:] - k
        inside[late[late >= 0]] = False
    return mix(out), inside


def _runs(known: np.ndarray, firsts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least `least` known places of one text."""
    edge = np.zeros(len(known) + 1, bool)
    edge[firsts] = True
    begins = known & (edge[:-1] | ~np.concatenate([[True], known[:-1]]))
    stops = known & (edge[1:] | ~np.concatenate([known[1:], [True]]))
    los, his = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    enough = his - los >= least
    return los[enough], his[enough]


def _least_of(grams: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours, once each: two runs that share n neighbours share one of these."""
    return np.unique(np.lib.stride_tricks.sliding_window_view(grams, n).min(axis=1))


def _classes(sizes: Iterable[int]) -> list[tuple[int, int]]:
    """(words of a gram, neighbouring grams that every window of the class has), for the items' window sizes."""
    short = [(n, 1) for n in sorted({n for n in sizes if n < GRAM})]
    long = [n for n in sizes if n >= GRAM]
    return short + ([(GRAM, min(long) - GRAM + 1)] if long else [])


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _pieces(items: DataFrame, width: int, piece_words: int) -> DataFrame:
    """Items' words in pieces; neighbours overlap by width - 1 words, so each window is whole in one of them."""
    chosen = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                *_, firsts, hashes = _tokens(part.column("text"))
                cuts = [(d, s, min(s + piece_words + width - 1, hi)) for d, (lo, hi) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True)) if hi > lo
                        for s in range(lo, max(lo + 1, hi - width + 1), piece_words)]
                yield pa.RecordBatch.from_arrays([
                    part.column("item_id").take(pa.array([d for d, _, _ in cuts], pa.int64())),
                    pa.array([min(width, hi - lo) for _, lo, hi in cuts], pa.int32()), _lists([hashes[lo:hi] for _, lo, hi in cuts]),
                ], ["item_id", "size", "words"])

    return chosen.mapInArrow(run, "item_id string, size int, words array<bigint>")


def _with_grams(pieces: DataFrame, classes: list[tuple[int, int]], blocks: int) -> DataFrame:
    """pieces with their block, all grams of their class, and the keys among them."""
    needs = dict(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, keys = [], []
            for size, held in zip(batch.column("size").to_pylist(), batch.column("words"), strict=True):
                hashes = held.values.to_numpy(zero_copy_only=False).view(np.uint64)
                n = min(size, GRAM)
                made, inside = _grams(hashes, np.array([0, len(hashes)]), n)
                grams.append(made[inside])
                keys.append(_least_of(made[inside], needs[n]))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(grams), _lists(keys)], [*batch.schema.names, "grams", "keys"])

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int"))
    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))]))


def _sieve(pieces: DataFrame, bits: int) -> np.ndarray:
    """Which of 2**bits values the upper bits of the items' grams take, eight to a byte; at most 2**MOST_BITS of them."""
    size = min(1 << (bits - 3), PAGE)

    def page(values: pa.Table) -> pa.Table:
        taken = np.zeros(8 * size, np.uint8)
        taken[values.column("p").to_numpy() % (8 * size)] = 1
        return pa.table({"page": values.column("page").slice(0, 1), "held": pa.array([np.packbits(taken, bitorder="little").tobytes()], pa.binary())})

    places = pieces.select(F.explode("grams").alias("g")).select(F.shiftrightunsigned("g", 64 - bits).alias("p")).distinct()
    paged = places.withColumn("page", F.floor(F.col("p") / (8 * size))).groupBy("page").applyInArrow(page, "page bigint, held binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in paged.toLocalIterator():
        out[row.page * size : (row.page + 1) * size] = np.frombuffer(row.held, np.uint8)
    return out


def _candidates(docs: DataFrame, sieve, bits: int, classes: list[tuple[int, int]]) -> DataFrame:
    """Stretches of the texts (columns key, text) that could hold a window: neighbouring grams that items may have."""
    schema = "key string, first bigint, stretch string, words array<bigint>, keys array<bigint>"
    drop = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                *_, firsts, hashes = _tokens(part.column("text"))
                owners, begins, held, keys = [], [], [], []
                for n, least in classes:
                    grams, known = _grams(hashes, firsts, n)
                    at = grams >> drop
                    known &= (sieve.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    los, his = _runs(known, firsts, least)
                    of = np.searchsorted(firsts, los, "right") - 1
                    owners.append(of)
                    begins.append(los - firsts[of])
                    for lo, hi in zip(los.tolist(), his.tolist(), strict=True):
                        held.append(hashes[lo : hi + n - 1])
                        keys.append(_least_of(grams[lo:hi], least))
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(pa.array(np.concatenate([np.zeros(0, np.int64), *owners]))), pa.array(np.concatenate([np.zeros(0, np.int64), *begins])),
                    pa.array([hashlib.md5(h.tobytes(), usedforsecurity=False).hexdigest() for h in held], pa.string()), _lists(held), _lists(keys),
                ], ["key", "first", "stretch", "words", "keys"])

    return docs.mapInArrow(run, schema)


def _match(width: int):
    """Hits of a part's stretches in the automaton of its block of pieces."""
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(pieces: pa.Table, stretches: pa.Table) -> pa.Table:
        names, spans, ids = [], [], []
        if pieces.num_rows and stretches.num_rows:
            read = lambda x: x.values.to_numpy(zero_copy_only=False).view(np.uint64)
            automaton = build(list(zip(pieces.column("item_id").to_pylist(), map(read, pieces.column("words")), strict=True)), width)
            for name, held in zip(stretches.column("stretch").to_pylist(), map(read, stretches.column("words")), strict=True):
                at = np.minimum(np.searchsorted(automaton.vocabulary, held), len(automaton.vocabulary) - 1)
                got: list[tuple[int, int]] = []
                found: set[str] = set()
                _stream(automaton, np.where(automaton.vocabulary[at] == held, at, -1).tolist(), 0, width, got, found)
                if got:
                    names.append(name)
                    spans.append([{"first": lo, "last": hi} for lo, hi in _merged(got)])
                    ids.append(sorted(found))
        return pa.table({"stretch": pa.array(names, pa.string()), "spans": pa.array(spans, spans_type), "ids": pa.array(ids, pa.list_(pa.string()))})

    return run


def _hits(docs: DataFrame, items: DataFrame, width: int, block_words: int) -> DataFrame:
    """Spans and item_ids of the different texts (columns key, text) that hold a window."""
    spark = docs.sparkSession
    raw = stored(_pieces(items, width, PIECE_WORDS), "pieces")
    sizes = raw.groupBy("size").agg(F.sum(F.size("words")).alias("n")).collect()  # a row for each size up to width
    total = sum(r.n for r in sizes)
    classes = _classes([r["size"] for r in sizes])
    pieces = stored(_with_grams(raw, classes, max(1, -(-total // block_words))), "blocks")
    bits = min(max((32 * total).bit_length(), LEAST_BITS), MOST_BITS)
    sieve = spark.sparkContext.broadcast(_sieve(pieces, bits))
    places = stored(_candidates(docs, sieve, bits, classes), "stretches")

    # each different stretch is streamed once, through the blocks that share a key with it
    contents = places.groupBy("stretch").agg(F.first("words").alias("words"), F.first("keys").alias("keys"))
    blocks = pieces.select("block", F.explode("keys").alias("k")).distinct()
    meets = contents.select("stretch", F.explode("keys").alias("k")).join(blocks, "k").select("stretch", "block").distinct()
    routed = stored(meets.join(contents.drop("keys"), "stretch"), "routed")
    parts = routed.groupBy("block").agg(F.ceil(F.sum(F.size("words")) / PART_WORDS).cast("int").alias("parts"))
    left = pieces.select("block", "item_id", "words").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = routed.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("stretch"), F.col("parts")).cast("int")).drop("parts")
    matched = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        _match(width), "stretch string, spans array<struct<first: bigint, last: bigint>>, ids array<string>"
    )
    shifted = F.transform("spans", lambda s: F.struct((s["first"] + F.col("first")).alias("first"), (s["last"] + F.col("first")).alias("last")))
    return places.select("key", "first", "stretch").distinct().join(matched, "stretch").groupBy("key").agg(
        F.flatten(F.collect_list(shifted)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids")
    )


def find(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (a column text) with n_words, n_hit, spans, item_ids and rest.

    A window is `width` consecutive words of an item, or all words of a shorter one.  Each word of a
    document inside an occurrence of a window is hit.  spans are the maximal runs of hit words, as
    word numbers, last one not included; item_ids are the items whose windows occur; rest is the
    text with those runs cut out where there are any, else null.

    Items are cut into overlapping pieces and dealt to blocks, whose automata are built in tasks.  One
    pass over docs finds the stretches whose grams items may have; each different stretch streams
    through the automata of the blocks that share a gram with it, and hits return by the text's digest.

    Null and empty texts have no words; items without words match nothing; without items nothing is
    hit; equal item ids count once; repeated rows of docs fare alike, very long texts are read whole,
    an empty table stays empty; columns of docs of these names are replaced.
    """
    base = docs.drop(*FOUND.fieldNames())
    key = "_digest"
    while key in {c.lower() for c in base.columns}:
        key += "_"
    text = base.select(F.md5("text").alias("key"), "text").where(F.col("text").isNotNull())
    hits = stored(_hits(text, items, width, block_words), "hits")
    known = hits.select(F.col("key").alias(key), F.col("spans").alias("spans"), "item_ids")
    joined = base.withColumn(key, F.md5("text")).join(known, key, "left")
    schema = T.StructType([*base.schema.fields, *FOUND.fields])
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets, starts, ends, firsts = _places(part.column("text"))
                held = [_merged([(s["first"], s["last"]) for s in spans]) if spans else [] for spans in part.column("spans").to_pylist()]
                rest: list[str | None] = [None] * part.num_rows
                for d, spans in enumerate(held):
                    if spans:
                        place, kept = int(offsets[d]), []
                        for lo, hi in spans:
                            kept.append(data[place : starts[firsts[d] + lo]].tobytes())
                            place = int(ends[firsts[d] + hi - 1])
                        kept.append(data[place : offsets[d + 1]].tobytes())
                        rest[d] = b"".join(kept).decode("utf-8", "replace")
                added = {
                    "n_words": pa.array(np.diff(firsts), pa.int64()),
                    "n_hit": pa.array([sum(hi - lo for lo, hi in spans) for spans in held], pa.int64()),
                    "spans": pa.array([[{"first": lo, "last": hi} for lo, hi in spans] for spans in held], spans_type),
                    "item_ids": pa.array([ids or [] for ids in part.column("item_ids").to_pylist()], pa.list_(pa.string())),
                    "rest": pa.array(rest, pa.string()),
                }
                own = [c for c in part.schema.names if c not in added and c != key]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in own], *added.values()], [*own, *added])

    return joined.select(*base.columns, "spans", "item_ids").mapInArrow(run, schema)


def decontaminated(docs: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without hit runs of words, and without documents of which more than max_coverage percent is hit.

    Documents without words stay; see `find` for nulls, repeats, ties and empty tables.  Other
    columns stay as they are, but for those that `find` names, which it replaces.
    """
    found = find(docs, items).where(F.col("n_hit") * 100 <= F.col("n_words") * max_coverage)
    return found.withColumn("text", F.coalesce("rest", "text")).select(*docs.columns)


def items_digest(ids: Column) -> Column:
    return F.sha2(F.encode(F.array_join(F.array_sort(ids), ","), "UTF-8"), 256)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        items_digest(F.col("item_ids")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""WITH split AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
windows AS (
  SELECT DISTINCT id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM split WHERE kind = 'i' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT d.id, d.k, d.size, x.id AS item
  FROM (SELECT id, size, k, array_to_string(w[k : k + size - 1], ' ') AS win
        FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM split, sizes WHERE kind = 'd' AND len(w) >= size)) d
  JOIN windows x ON x.size = d.size AND x.win = d.win),
hit AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(k, k + size)) AS p FROM found) GROUP BY id),
named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM found) GROUP BY id)
SELECT s.id AS doc_id, len(s.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit h ON h.id = s.id LEFT JOIN named m ON m.id = s.id WHERE s.kind = 'd'
"""
