"""Cross-tokenizer alignment: groups of tokens that cover the same bytes, found by pointer jumping.

A text is encoded twice.  Every token points to the farthest-right token of the other encoding
that it overlaps; doubling the successors leads each token to the last one of its component, and
that is the label of its group.  All tokens of a slice of documents are labelled at once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import layout, slices, stored, table, word_hashes

#: Where the vocabulary files lie, and the two that the query compares.
FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Documents aligned together, and texts hashed together, in bytes; pieces encoded together.
WINDOW_BYTES, HASHED_BYTES, ENCODED = 3 << 20, 1 << 20, 2_000

#: Fixed value: the character that stands for a space in pieces.
SPACE_MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _Pair:
    """Both encoders with their tokens' bytes; made once in each worker."""

    def __init__(self, folder: str, first: str, second: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(f"{folder}/{first}")
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{second}")
        letters = _byte_letters()
        special = {x["content"] for x in json.loads(self.first.to_str()).get("added_tokens") or []}
        vocabulary = self.first.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.a_bytes[k] = token.encode() if token in special else bytes(letters[c] for c in token)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        #: Ids with what may follow them in the written form of a group.
        self.written = [f"{k}{end}" for k in range(max(len(self.a_bytes), len(self.b_bytes))) for end in ",|;"]
        #: No piece holds a space after another character, so encodings never cross the places where texts are cut.
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a space (which the second encoder adds by itself)."""
        return [x.ids for x in self.first.encode_batch_fast(texts, add_special_tokens=False)], self.second.encode([x[1:] for x in texts], num_threads=1)


@lru_cache(maxsize=2)
def _pair(folder: str, first: str, second: str) -> _Pair:
    return _Pair(folder, first, second)


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place (3 or more) is surely no white space.

    Outside ASCII, all white space is among the two-byte characters of C2 and the three-byte ones of E1 to E3.
    """
    before, two, three = data[at - 1], data[at - 2], data[at - 3]
    return ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (two != 0xC2) & ~((three >= 0xE1) & (three <= 0xE3)))


def _cut(data: np.ndarray, offsets: np.ndarray, allowed: bool) -> np.ndarray:
    """Starts of the pieces that are encoded once: each text's start, and each single space between two other characters.

    Both encodings break before such a space whatever stands around it, unless white space comes before it.
    """
    first = offsets[:-1][np.diff(offsets) > 0]
    if not allowed or not len(data):
        return first
    at = np.flatnonzero(data == 0x20)
    at = at[(at >= 3) & (at + 1 < len(data))]
    at = at[_solid(data, at) & (data[at + 1] != 0x20)]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = at[~edge[at] & ~edge[at + 1]]
    return np.union1d(first, at)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + HASHED_BYTES, "right")))
        base = starts[lo]
        out[lo:hi] = word_hashes(data[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return out


def _encoded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pair: _Pair) -> tuple[np.ndarray, ...]:
    """An order of the pieces; in that order, ids and their numbers by piece for both encoders, and which pieces their tokens spell.

    Pieces that can follow each other in a text are joined in runs and encoded as one: their tokens
    break at the pieces' ends, and a run where they do not, or do not spell it, is done piece by
    piece, as are the pieces that cannot be joined.  Pieces that are not spelt have no tokens.
    """
    size = ends - starts
    fits = (size > 3) & pair.cuts
    fits[fits] = (data[starts[fits] + 1] != 0x20) & _solid(data, ends[fits])
    joined, single = np.flatnonzero(fits), [np.flatnonzero(~fits)]
    order, runs = [], []
    raw = lambda k: data[starts[k] : ends[k]].tobytes()
    for lo in range(0, len(joined), ENCODED):
        part = joined[lo : lo + ENCODED]
        text = b"".join(map(raw, part.tolist()))
        places = np.cumsum(size[part])
        made = []
        for ids, spelt, sizes in zip(pair.encode([text.decode("utf-8", "replace")]), (pair.a_bytes, pair.b_bytes), (pair.a_size, pair.b_size), strict=True):
            ids = np.array(ids[0], np.int64)
            at = np.cumsum(sizes[ids])
            upto = np.searchsorted(at, places, "right")
            if b"".join(map(spelt.__getitem__, ids.tolist())) == text and np.array_equal(at[upto - 1], places):
                made += [ids, np.diff(upto, prepend=0)]
        if len(made) == 4:
            order.append(part)
            runs.append((*made, np.ones(len(part), bool)))
        else:
            single.append(part)
    rest = np.concatenate(single)
    for lo in range(0, len(rest), ENCODED):
        part = rest[lo : lo + ENCODED]
        texts = list(map(raw, part.tolist()))
        a, b = pair.encode([x.decode("utf-8", "replace") for x in texts])
        good = np.ones(len(part), bool)
        for k, x in enumerate(texts):
            if not b"".join(map(pair.a_bytes.__getitem__, a[k])) == x == b"".join(map(pair.b_bytes.__getitem__, b[k])):
                good[k], a[k], b[k] = False, [], []
        order.append(part)
        runs.append((*_flat(a), *_flat(b), good))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in ([order, *zip(*runs, strict=True)] if runs else [[empty]] * 5 + [[np.zeros(0, bool)]]))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of the first and second encoding's tokens, and each first token's farthest second one.

    Ends are byte offsets of all tokens in a row, over the same bytes.  The label of a component
    is the place of its last token in the second encoding.
    """
    n = len(a_ends)
    far = np.searchsorted(b_ends, a_ends - 1, "right")
    back = np.searchsorted(a_ends, b_ends - 1, "right")
    ends_here = a_ends[back] == b_ends if len(b_ends) else np.zeros(0, bool)
    points = np.concatenate([far + n, np.where(ends_here, np.arange(len(b_ends)) + n, back)])
    while True:
        jumped = points[points]
        if np.array_equal(jumped, points):
            return points[:n] - n, points[n:] - n, far
        points = jumped


def _sums(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of runs values[index[k] : index[k + 1]], empty ones included."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[index[1:]] - running[index[:-1]]


def _aligned(texts: pa.Array, pair: _Pair) -> dict:
    """What one window of documents gives: numbers for each document, its pieces, and the pairs of ids with how often they are linked."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    empty = pc.equal(filled, "")
    spaced = pc.if_else(empty, pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), filled, pa.scalar("", pa.large_string())))
    data, offsets = layout(spaced)
    n = len(offsets) - 1
    starts = _cut(data, offsets, pair.cuts)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    firsts = np.searchsorted(starts, offsets)
    _, at, piece = np.unique(_hashed(data, starts, ends), return_index=True, return_inverse=True)
    order, a_ids, n_a, b_ids, n_b, good = _encoded(data, starts[at], ends[at], pair)
    rank = np.empty(len(at), np.int32)
    rank[order] = np.arange(len(at), dtype=np.int32)
    piece = rank[piece]
    a_ends, b_ends = np.cumsum(pair.a_size[a_ids]), np.cumsum(pair.b_size[b_ids])
    a_label, b_label, far = terminals(a_ends, b_ends)

    # pieces hold whole groups: numbers by piece
    a_index, b_index = (np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b))
    n_groups = _sums(b_label == np.arange(len(b_ids)), b_index)
    near = np.searchsorted(b_ends, a_ends - pair.a_size[a_ids], "right")
    width = far - near + 1
    links = np.repeat(np.arange(len(a_ids)), width)
    second = np.arange(len(links)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(near, width)
    keys = a_ids[links] * len(pair.b_bytes) + b_ids[second]
    n_links = _sums(width, a_index)

    # the written form: tokens by group, the first encoding's before the second's
    label = np.concatenate([a_label, b_label])
    side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
    order = np.lexsort((side, label))
    last = np.ones(len(order), bool)
    last[:-1] = (label[order[1:]] != label[order[:-1]]) | (side[order[1:]] != side[order[:-1]])
    shown = list(map(pair.written.__getitem__, (np.concatenate([a_ids, b_ids])[order] * 3 + last * (1 + side[order])).tolist()))
    shown_index = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    written = ["".join(shown[lo:hi]) for lo, hi in zip(shown_index[:-1], shown_index[1:], strict=True)]

    # numbers by document
    whole = _sums(~good[piece], firsts) == 0
    doc = np.repeat(np.arange(n), np.diff(firsts))
    counted = whole[doc]
    times = np.bincount(piece[counted], minlength=len(at)).astype(np.int64)
    found = {name: np.where(whole, _sums(x[piece], firsts), 0) for name, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links))}
    groups = ["".join(map(written.__getitem__, piece[firsts[d] : firsts[d + 1]].tolist()))[:-1] if whole[d] else "" for d in range(n)]
    held, held_times = np.unique(doc[counted] * max(1, len(at)) + piece[counted], return_counts=True)
    held_doc = held // max(1, len(at))
    pairs, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, weights=np.repeat(times, n_links), minlength=len(pairs)).astype(np.int64)
    return found | {
        "groups": groups, "held": (held % max(1, len(at))).astype(np.int32), "held_times": held_times.astype(np.int32),
        "held_index": np.searchsorted(held_doc, np.arange(n + 1)).astype(np.int32),
        "pairs": pairs, "total": total, "links": place.astype(np.int32), "link_index": np.concatenate([[0], np.cumsum(n_links)]).astype(np.int64),
    }


#: Columns made for a document; `groups` is its groups in the written form `a1,a2|b1;a3|b2,b3`.
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


#: Arrays of a window that go packed: which pieces a document holds and how often, and each piece's links as places among the pairs.
PACKED = ("held", "held_times", "held_index", "links", "link_index")


def _packed(values: np.ndarray) -> bytes:
    """32-bit integers, byte by byte of their differences, compressed."""
    steps = np.diff(values.astype(np.int32), prepend=np.int32(0))
    return len(values).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], 4 * n, "zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view(np.int32).ravel(), dtype=np.int32)


def _windows(docs: DataFrame, keep: list[str], folder: str, first: str, second: str, whole: bool) -> DataFrame:
    """Stored rows of two parts for each window: its documents, and one row of its pairs and pieces."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    packed = ", ".join(f"_{c} binary" for c in PACKED)
    schema = f"{types}, _window bigint, _place int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, _pairs array<bigint>, _total array<bigint>, {packed}"
    names = [*keep, "_window", "_place", *NUMBERS[:4], "groups", "_pairs", "_total", *[f"_{c}" for c in PACKED]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(folder, first, second)
        for batch in batches:
            for part in slices(batch, "_text", WINDOW_BYTES):
                found = _aligned(part.column("_text"), pair)
                n, window = part.num_rows, int.from_bytes(os.urandom(8), "big") >> 1
                groups = found["groups"] if whole else [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"]]
                own, longs = [part.column(k) for k in range(len(keep))], pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    *own, pa.array(np.full(n, window)), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(found[c], pa.int64()) for c in NUMBERS[:4]], pa.array(groups, pa.string()),
                    *[pa.nulls(n, longs)] * 2, *[pa.nulls(n, pa.binary())] * len(PACKED),
                ], names)
                yield pa.RecordBatch.from_arrays([
                    *[pa.nulls(1, c.type) for c in own], pa.array([window]), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                    pa.array([found["pairs"]], longs), pa.array([found["total"]], longs), *[pa.array([_packed(found[c])], pa.binary()) for c in PACKED],
                ], names)

    return stored(docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema), "aligned")


def pair_counts(windows: DataFrame) -> DataFrame:
    """pair (first id times the second vocabulary's size plus second id) and count: its links over all documents."""
    each = windows.where("_place is null").select(F.explode(F.arrays_zip("_pairs", "_total")).alias("x")).select(F.col("x._pairs").alias("pair"), F.col("x._total").alias("n"))
    return each.where("n > 0").groupBy("pair").agg(F.sum("n").alias("count"))


def align(docs: DataFrame, keep: list[str], folder: str = FOLDER, first: str = FIRST, second: str = SECOND, whole: bool = True) -> DataFrame:
    """Columns `keep` of docs (which has a column text) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    A text is encoded as a space and itself by `first`, and as itself by `second`, which adds the
    space.  Where tokens of both end at one byte, a group ends.  Two tokens that overlap are
    linked; the count of a pair of ids is the number of links over all documents that have it.
    n_best counts links of the pairs that are most frequent for their second id (ties included),
    count_sum adds the counts of all links.  `groups` is written as ids, `a1,a2|b1;a3|b2,b3`, or,
    where not `whole`, as that text's SHA-256 in lowercase hex.

    Each window of documents cuts its texts where neither encoding can cross, encodes each
    different piece once, and gives its different pairs of ids a row; counts come back by window
    and pair, so no pair's links gather in a task and no vocabulary product is broadcast.  Only the
    highest count of each second id is, one row an id at most.

    Null and empty texts, and those that tokens of either encoder do not spell byte for byte, have
    no tokens: zeros, and empty groups.  Repeated rows each count; a very long text is a window of
    its own; an empty table stays empty; kept columns named like the results are replaced by them.
    """
    keep = [c for c in keep if c not in (*NUMBERS, "groups")]
    n_second = len(_pair(folder, first, second).b_bytes)
    windows = _windows(docs, keep, folder, first, second, whole)
    counts = stored(pair_counts(windows).withColumn("second", (F.col("pair") % n_second).cast("int")), "pairs")
    highest = counts.groupBy("second").agg(F.max("count").alias("top"))
    ranked = counts.join(F.broadcast(highest), "second").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    asked = windows.where("_place is null").select("_window", F.explode("_pairs").alias("pair"))
    known = asked.join(ranked, "pair").select(F.col("_window").alias("_of"), "pair", "count", "best")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def scored(rows: pa.Table, known: pa.Table) -> pa.Table:
        alone = pc.is_null(rows["_place"])
        own, window = rows.filter(pc.invert(alone)), rows.filter(alone)
        held, times, spans, links, index = (_unpacked(window[f"_{c}"][0].as_py()) for c in PACKED)
        pairs = window["_pairs"].combine_chunks().flatten().to_numpy()
        place = np.searchsorted(pairs, known["pair"].to_numpy())
        made = []
        for c in ("best", "count"):
            score = np.zeros(len(pairs), np.int64)
            score[place] = known[c].to_numpy(zero_copy_only=False) if c == "best" else known[c].to_numpy()
            made.append(_sums(_sums(score[links], index)[held] * times, spans)[own["_place"].to_numpy()])
        return pa.table([*[own[c] for c in (*keep, *NUMBERS[:4])], *[pa.array(x, pa.int64()) for x in made], own["groups"]], names=[*keep, *NUMBERS, "groups"])

    return windows.drop("_total").groupBy("_window").cogroup(known.groupBy("_of")).applyInArrow(scored, f"{out}, {', '.join(f'{c} bigint' for c in NUMBERS)}, groups string")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), ["doc_id"], whole=False).withColumnRenamed("groups", "groups_sha256")
