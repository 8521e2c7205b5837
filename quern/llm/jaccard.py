"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import LOWER, NOT_SPACE, discard, layout, mix, shingle_hashes, slices, stored, table, word_hashes, words
from quern.llm.graph import components

WIDTH = 5
#: Documents link at SHARED of TOTAL: five times the intersection is at least four times the union.
SHARED, TOTAL = 4, 5
#: Bits of a signature: the next power of two from so many times the set's size on, within these.
BITS_EACH, FEWEST_BITS, MOST_BITS = 4, 512, 1 << 19
#: Bytes of the coarse signature, which most pairs do not pass: the signature folded.
COARSE = FEWEST_BITS // 8
#: Nearest sets, by signature, that each set of a large tile tries before all the rest.
NEAREST = 2
#: Representatives are broadcast up to so many (some 10 MB); beyond it their join shuffles.
BROADCAST_NODES = 200_000
#: Shingles seen in so many documents, or more, come last in the order of shingles: so many of them at the most.
FREQUENT, MOST_FREQUENT = 24, 1 << 20
#: Documents in a run whose own frequent shingles are reported.
RUN = 8_192
#: Tiles of up to so many sets give all their pairs of fitting size at once.
SMALL_TILE = 6
#: Larger tiles are cut into size bands, and bands into blocks of so many sets; two blocks meet in one task.
BLOCK = 1_000
#: Postings of a shingle that more documents have than this are dealt to several groups before they meet.
DEALT = 1 << 16
#: Postings to a bucket.
BUCKET = 250_000
LARGE = 65_535


def sets_of(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, and where each text's begin (n + 1 entries)."""
    data, offsets = layout(texts)
    lower = LOWER[data]
    starts, ends, firsts = words(lower, offsets, NOT_SPACE)
    hashes, index = shingle_hashes(word_hashes(lower, starts, ends), firsts, width)
    for lo, hi in zip(index[:-1].tolist(), index[1:].tolist(), strict=True):
        hashes[lo:hi].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[index[:-1][index[:-1] < len(hashes)]] = True
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[index]


def _per_set(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of 64-bit values by set, empty sets 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[index[1:]] - total[index[:-1]]


def node_ids(sets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set: equal sets are one node of the graph."""
    return mix(_per_set(mix(sets ^ np.uint64(0x5BD1E9955BD1E995)), index) + np.diff(index).astype(np.uint64)).view(np.int64)


def signatures(sets: np.ndarray, index: np.ndarray) -> list[bytes]:
    """Parity bitmaps: bit k is the parity of the set's hashes that fall on k.

    Hashes in both sets cancel, so two bitmaps differ in at most as many bits as the sets in
    members.  A bitmap's halves, combined, are the bitmap of half the bits.
    """
    sizes = np.diff(index)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(sizes * BITS_EACH, 1))).astype(np.int64), FEWEST_BITS, MOST_BITS)
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = base[owner] + (sets & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    edges = (base // 8).tolist()
    return [packed[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap in `size` bytes, as words."""
    words = np.frombuffer(bits, np.uint64)
    while 8 * len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """So many members in any one order: two sets that link share one of them."""
    return np.where(n > 0, n - (SHARED * n + TOTAL - 1) // TOTAL + 1, 0)


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes that allow a link; sizes are cut at LARGE, which fits itself."""
    return SHARED * np.maximum(a, b) <= TOTAL * np.minimum(a, b)


def _scan(docs: DataFrame) -> DataFrame:
    """One row for each document (node, size, signature) and rows for shingles that a run of documents has twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "hash", "n", "node", "bits", "coarse", "token", "found"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        held: list[np.ndarray] = []
        docs_held = 0

        def frequent() -> pa.RecordBatch:
            token, found = np.unique(np.concatenate(held), return_counts=True)
            keep = found >= 2
            none = [pa.nulls(int(keep.sum()), k) for k in kinds[:6]]
            return pa.RecordBatch.from_arrays([*none, pa.array(token[keep].view(np.int64)), pa.array(found[keep].astype(np.int64))], names)

        for batch in batches:
            for part in slices(batch):
                sets, index = sets_of(part.column("text"))
                held.append(sets)
                docs_held += part.num_rows
                bits = signatures(sets, index)
                coarse = [folded(x, COARSE).tobytes() for x in bits]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("hash"), pa.array(np.diff(index)), pa.array(node_ids(sets, index)), pa.array(bits, pa.binary()), pa.array(coarse, pa.binary()),
                        pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.int64()),
                    ],
                    names,
                )
                if docs_held >= RUN or sum(map(len, held)) > 2_000_000:
                    yield frequent()
                    held, docs_held = [], 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, "doc_id long, hash long, n long, node long, bits binary, coarse binary, token long, found long")


def _frequent(scanned: DataFrame, dealt: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come last, sorted, and in how many parts each one's postings are dealt (a power of two).

    They only set the order of shingles and the dealing: any order finds all links.  At most
    MOST_FREQUENT pairs of numbers reach the driver, as packed columns.
    """
    often = scanned.where("token is not null").groupBy("token").agg(F.sum("found").alias("found")).where(F.col("found") >= FREQUENT)
    kept = often.orderBy(F.desc("found"), "token").limit(MOST_FREQUENT).select("token", "found").toArrow()
    token, found = kept.column("token").to_numpy().view(np.uint64), kept.column("found").to_numpy()
    order = np.argsort(token)
    return token[order], (1 << np.ceil(np.log2(np.maximum(found[order] / dealt, 1))).astype(np.int64)).astype(np.uint32)


def _postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """Prefix members of each set as packed arrays of (key, node, size), by bucket of the key.

    The order of members is: frequent ones last, then by hash.  Sets met before in a task are left
    out.  A posting of a dealt shingle stands in a row of its shingle and salt, by hash of the node.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = shared.value
        met: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                sets, index = sets_of(part.column("text"))
                nodes, sizes = node_ids(sets, index), np.diff(index)
                new = np.zeros(len(nodes), bool)
                for k, node in enumerate(nodes.tolist()):
                    if node not in met:
                        new[k] = True
                        met.add(node)
                if len(met) > 1_000_000:
                    met = set()
                owner = np.repeat(np.arange(len(nodes)), sizes)
                place = np.minimum(np.searchsorted(last, sets), len(last) - 1)
                late = last[place] == sets if len(last) else np.zeros(len(sets), bool)
                early = np.concatenate([[0], np.cumsum(~late)])
                rank = early[:-1] - early[index[:-1]][owner]
                within = np.arange(len(sets)) - index[:-1][owner]
                plain = (early[index[1:]] - early[index[:-1]])[owner]
                rank = np.where(late, plain + within - rank, rank)
                at = np.flatnonzero((rank < prefix_sizes(sizes)[owner]) & new[owner])
                token, node, size = sets[at], nodes[owner[at]], np.minimum(sizes[owner[at]], LARGE).astype(np.uint16)
                dealt = np.where(late[at], parts[place[at]], 1) if len(last) else np.ones(len(at), np.int64)
                salt = np.where(dealt > 1, (mix(node.view(np.uint64)) & (dealt - 1).astype(np.uint64)).astype(np.int64), -1)
                bucket = np.where(dealt > 1, -1, ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
                order = np.lexsort((salt, np.where(dealt > 1, token, np.uint64(0)), bucket))
                token, node, size, salt, bucket = token[order], node[order], size[order], salt[order], bucket[order].astype(np.int32)
                key = token.astype(np.uint32)
                apart = (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1]) | ((salt[1:] >= 0) & (token[1:] != token[:-1]))
                edges = np.flatnonzero(np.concatenate([[True], apart])) if len(bucket) else np.zeros(0, np.int64)
                stops = np.concatenate([edges[1:], [len(bucket)]]) if len(edges) else edges
                cut = list(zip(edges.tolist(), stops.tolist(), strict=True))
                alone = salt[edges] >= 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[edges]), pa.array(np.where(alone, token[edges].view(np.int64), 0)), pa.array(np.where(alone, salt[edges], -1).astype(np.int32)),
                        pa.array([key[a:b].tobytes() for a, b in cut], pa.binary()),
                        pa.array([node[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([size[a:b].tobytes() for a, b in cut], pa.binary()),
                    ],
                    ["bucket", "token", "salt", "keys", "nodes", "sizes"],
                )

    return docs.mapInArrow(run, "bucket int, token long, salt int, keys binary, nodes binary, sizes binary")


def _unpack(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _hung(nodes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Few pairs that connect a tile of look-alikes: neighbours by size and by hash, and stars by size band."""
    spread = mix(nodes.view(np.uint64))
    n = len(nodes)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(SHARED * sizes, TOTAL * sizes[lo], "right"))
        band = lo + np.argsort(spread[lo:hi], kind="stable")
        for c in band[:3]:
            yield np.full(hi - lo, c), np.arange(lo, hi)
        yield band[:-1], band[1:]
        lo = hi
    yield np.arange(n - 1), np.arange(1, n)


def _blocks(nodes: np.ndarray, sizes: np.ndarray, salt: int, block: int) -> list[tuple[int, np.ndarray]]:
    """A tile's sets, which come by size, in blocks: size bands that only fit themselves and their neighbours, each cut by hash.

    A block's number holds its band from bit 40 on.
    """
    band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(TOTAL / SHARED) + 1e-9).astype(np.int64)
    spread = mix(nodes.view(np.uint64))
    out = []
    for value in np.unique(band):
        own = np.flatnonzero(band == value)
        own = own[np.argsort(spread[own], kind="stable")]
        for k, cut in enumerate(np.array_split(own, -(-len(own) // block))):
            out.append(((int(value) << 40) | (salt << 20) | k, nodes[cut]))
    return out


def _tiles(postings: DataFrame, block: int) -> DataFrame:
    """Candidate pairs (a, b), and for tiles of more than SMALL_TILE sets a row for each block of their nodes.

    A tile is the sets whose prefixes share a key, in order of size.  A dealt shingle's tile comes
    in parts; each part's blocks are rows whatever their number, with the part's mark (the parts'
    marks combine to the tile's) and two nodes that stand for it.
    """

    def run(group: pa.Table) -> pa.Table:
        keys, nodes = _unpack(group.column("keys"), np.uint32), _unpack(group.column("nodes"), np.int64)
        sizes = _unpack(group.column("sizes"), np.uint16).astype(np.int64)
        token, salt = group.column("token")[0].as_py(), group.column("salt")[0].as_py()
        both = (keys.astype(np.uint64) << np.uint64(16)) | sizes.astype(np.uint64)
        order = np.lexsort((nodes, both))
        both, nodes, sizes = both[order], nodes[order], sizes[order]
        keep = np.ones(len(both), bool)
        keep[1:] = (both[1:] != both[:-1]) | (nodes[1:] != nodes[:-1])
        both, nodes, sizes = both[keep], nodes[keep], sizes[keep]
        key = both >> np.uint64(16)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stop = np.concatenate([begin[1:], [len(key)]])
        length = stop - begin
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, SMALL_TILE + 1):
            at = begin[length == n]
            for i in range(n):
                for j in range(i + 1, n):
                    ok = fits(sizes[at + i], sizes[at + j])
                    left.append(nodes[at + i][ok])
                    right.append(nodes[at + j][ok])
        met: set[int] = set()
        blocks: list[tuple] = []
        large = (length > SMALL_TILE) | (salt >= 0)
        for lo, hi in zip(begin[large].tolist(), stop[large].tolist(), strict=True):
            own = nodes[lo:hi]
            spread = mix(own.view(np.uint64))
            mark = int(np.bitwise_xor.reduce(spread).view(np.int64))
            if mark in met:
                continue
            met.add(mark)
            least = own[np.argsort(spread)[:2]].tolist()
            for k, (number, cut) in enumerate(_blocks(own, sizes[lo:hi], max(salt, 0), block)):
                blocks.append((token if salt >= 0 else mark, number, cut.tolist(), salt >= 0, mark if salt >= 0 and not k else 0, least if salt >= 0 and not k else []))
            for i, j in _hung(own, sizes[lo:hi]):
                ok = fits(sizes[lo:hi][i], sizes[lo:hi][j]) & (own[i] != own[j])
                left.append(own[i][ok])
                right.append(own[j][ok])
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        m = pairs.shape[1]
        tile, number, cut, dealt, mark, least = (list(x) for x in zip(*blocks, strict=True)) if blocks else ([], [], [], [], [], [])
        none = [None] * m
        return pa.table({
            "a": pa.array([*pairs[0].tolist(), *[None] * len(tile)], pa.int64()), "b": pa.array([*pairs[1].tolist(), *[None] * len(tile)], pa.int64()),
            "tile": pa.array([*none, *tile], pa.int64()), "block": pa.array([*none, *number], pa.int64()), "nodes": pa.array([*none, *cut], pa.list_(pa.int64())),
            "dealt": pa.array([*none, *dealt], pa.bool_()), "mark": pa.array([*none, *mark], pa.int64()), "least": pa.array([*none, *least], pa.list_(pa.int64())),
        })

    return postings.groupBy("bucket", "token", "salt").applyInArrow(run, "a long, b long, tile long, block long, nodes array<long>, dealt boolean, mark long, least array<long>")


def _once(tiles: DataFrame) -> DataFrame:
    """The blocks of different tiles: look-alikes share many shingles, and so many equal tiles, of which one is enough."""
    rows = tiles.where("tile is not null")
    marks = rows.where("dealt").groupBy("tile").agg(F.bit_xor("mark").alias("mark")).groupBy("mark").agg(F.min("tile").alias("tile")).select("tile")
    plain = rows.where("not dealt").dropDuplicates(["tile", "block"])
    return plain.union(rows.where("dealt").join(marks, "tile", "left_semi").select(*rows.columns)).select("tile", "block", "nodes")


def _chained(tiles: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the parts of a dealt tile: one part's nodes with the next one's and the first one's."""
    each = tiles.where("dealt and size(least) > 0").select("tile", "block", F.posexplode("least").alias("nth", "node"))
    along = Window.partitionBy("tile", "nth").orderBy("block")
    rows = each.select("node", F.lag("node").over(along).alias("before"), F.first("node").over(along).alias("first"))
    pairs = rows.select(F.explode(F.array(F.struct("before", "node"), F.struct(F.col("first").alias("before"), "node"))).alias("x")).where("x.before <> x.node")
    return pairs.select(F.least("x.before", "x.node").alias("a"), F.greatest("x.before", "x.node").alias("b"))


def _bounded(pairs: DataFrame, nodes: DataFrame, bits: str) -> DataFrame:
    """Pairs whose sizes and bit counts (of the named column) allow a link: nine times the differing bits is at most the sum of sizes."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col(bits).alias("bits_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col(bits).alias("bits_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            both = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)
            differ = np.array([np.bitwise_count(folded(x, min(len(x), len(y))) ^ folded(y, min(len(x), len(y)))).sum(dtype=np.int64) for x, y in both])
            ok = fits(n_a, n_b) & ((SHARED + TOTAL) * differ <= (TOTAL - SHARED) * (n_a + n_b))
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its sorted hashes, for the wanted (node, rep): read again from the text of document rep."""
    reps = wanted.select(F.col("rep.doc_id").alias("__quern_id"), F.col("rep.hash").alias("__quern_hash"), F.col("node").alias("__quern_node"), "copies")
    if wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        reps = F.broadcast(reps)
    chosen = docs.join(reps, F.col("doc_id").eqNullSafe(F.col("__quern_id")) & (F.col("hash") == F.col("__quern_hash"))).select("__quern_node", "text", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, index = sets_of(part.column("text"))
                blobs = [sets[lo:hi].tobytes() for lo, hi in zip(index[:-1].tolist(), index[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("__quern_node"), pa.array(blobs, pa.binary())], ["node", "members"])

    # rows repeated as a whole would give a node twice; nodes of one document cannot be repeated
    once = chosen.where("copies = 1").union(chosen.where("copies > 1").dropDuplicates(["__quern_node"]))
    return once.drop("copies").mapInArrow(run, "node long, members binary")


def _verified(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs that link, by intersecting their sorted arrays."""
    a = arrays.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    b = arrays.select(F.col("node").alias("b"), F.col("members").alias("of_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for left, right in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                ok.append(TOTAL * both >= SHARED * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long").distinct()


def _members(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Each node of each block, with its component (part)."""
    return blocks.select("tile", "block", F.explode("nodes").alias("node")).join(parts, "node", "left").select("tile", "block", "node", F.coalesce("component", "node").alias("part"))


def _crossing(members: DataFrame, nodes: DataFrame, nearest: int | None = None) -> DataFrame:
    """Pairs of a tile that no chain of links joins yet and whose sizes and signatures allow a link.

    All of them, in a task for each two blocks of the same or neighbouring bands that are not all
    of one component; or, inside blocks, for each set only those with its `nearest` larger sets by signature.
    """
    spans = members.groupBy("tile", "block").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    if nearest:
        work = spans.where("lo < hi").select("tile", F.array("block").alias("sides"))
    else:
        other = spans.select(F.col("tile").alias("other_tile"), F.col("block").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
        near = (F.col("block") <= F.col("other")) & (F.shiftright("other", 40) - F.shiftright("block", 40) <= 1)
        work = spans.join(other, (F.col("tile") == F.col("other_tile")) & near & (F.least("lo", "other_lo") < F.greatest("hi", "other_hi"))).select(
            "tile", F.array_distinct(F.array("block", "other")).alias("sides"))
    sides = work.select("tile", F.xxhash64("tile", "sides").alias("task"), (F.size("sides") > 1).alias("two"), F.explode("sides").alias("block"))
    rows = members.join(sides, ["tile", "block"]).join(nodes.select("node", "n", "bits"), "node").select("task", "two", "block", "node", "part", "n", "bits")

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("n").to_numpy(), kind="stable")
        n, node, part, side = (group.column(c).to_numpy()[order] for c in ("n", "node", "part", "block"))
        two = group.column("two")[0].as_py()
        bits = group.column("bits").take(pa.array(order)).to_pylist()
        width = np.array([len(x) for x in bits])  # grows with n, at most twofold between sizes that fit
        reach = np.searchsorted(SHARED * n, TOTAL * n, "right")
        left, right = [], []
        level, rows_of, lo = 0, np.zeros((0, 0), np.uint64), 0
        for i in range(len(n) - 1):
            if width[i] != level:
                level, lo = int(width[i]), i
                rows_of = np.stack([folded(x, level) for x in bits[i : int(np.searchsorted(width, 2 * level, "right"))]])
            j = np.arange(i + 1, reach[i])
            j = j[(part[j] != part[i]) & ((side[j] != side[i]) | (not two))]
            differ = np.bitwise_count(rows_of[j - lo] ^ rows_of[i - lo]).sum(axis=1, dtype=np.int64)
            able = (SHARED + TOTAL) * differ <= (TOTAL - SHARED) * (n[i] + n[j])
            j, differ = j[able], differ[able]
            if nearest and len(j) > nearest:
                j = j[np.argsort(differ, kind="stable")[:nearest]]
            left.append(np.full(len(j), node[i]))
            right.append(node[j])
        a, b = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return rows.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, block: int = BLOCK, dealt: int = DEALT) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, component_id and chosen, for every row of docs; see `linked`.

    One document of each component is chosen, that of the smallest doc_id (null last), then hash.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    scanned = stored(_scan(docs), "sets")
    each = scanned.where("node is not null").select("doc_id", "hash", "n", "node")
    size = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members")).first()
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    nodes = stored(
        scanned.where("n > 0").groupBy("node").agg(F.min(rank).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("coarse").alias("coarse"), F.count("*").alias("copies")),
        "nodes",
    )
    buckets = max(32, min(1 << 16, size.members // (5 * BUCKET)))
    tiles = stored(_tiles(_postings(docs, _frequent(scanned, dealt), buckets), block), "tiles")
    likely = stored(_bounded(tiles.where("a is not null").select("a", "b").union(_chained(tiles)).distinct(), nodes, "coarse"), "likely")
    pairs, large = stored(_bounded(likely, nodes, "bits"), "pairs"), stored(_once(tiles), "blocks")
    for done in (likely, tiles):
        discard(done)

    def checked(some: DataFrame) -> DataFrame:
        ends = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
        arrays = stored(_arrays(docs, nodes.join(ends, "node")), "arrays")
        found = stored(_verified(some, arrays), "links")
        discard(arrays)  # about as large as the texts they are of
        return found

    links = checked(pairs)
    parts = stored(components(links), "parts")
    for nearest in (NEAREST, None):  # first the likely links of large groups, then every pair that is left
        members = stored(_members(large, parts), "members")
        crossing = stored(_crossing(members, nodes, nearest).join(pairs, ["a", "b"], "left_anti"), "crossing")
        discard(members)
        if not crossing.isEmpty():
            links, pairs = stored(links.union(checked(crossing)), "links"), pairs.union(crossing)
            parts = stored(components(links), "parts")
    own = nodes.join(parts, "node", "left")
    least = own.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = own.where("component is not null or copies > 1").join(least, "component", "left").select("node", F.coalesce("least", "rep").alias("first"))
    alone = F.col("first").isNull() | (F.col("n") == 0)
    return each.join(named, "node", "left").select(
        "doc_id", "hash", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash")))).alias("chosen"),
    )


def linked(docs: DataFrame, block: int = BLOCK, dealt: int = DEALT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (columns doc_id, text).

    Texts are lower-cased (A-Z) and split at white space; a set is the distinct 5-word shingles, or
    the whole sequence of a shorter text.  Two documents link when 100 * intersection >= 80 * union;
    component_id is the smallest doc_id reachable by links.  Sets are compared by 64-bit hashes of
    their shingles.

    Equal sets are one node, so exact copies cost nothing past the first scan.  Nodes meet in tiles:
    those whose prefixes (the first fifth in one order, frequent shingles last) share a shingle, in
    order of size.  Large tiles are cut into size bands and blocks.  They first try a few pairs for each set; once those links are
    components, only pairs between different components are left to compare, by signatures, then
    exactly.  So a large group of near copies is joined without all of its pairs, and no link
    between components is missed.

    An empty table stays empty; other columns of docs, whatever their names, are not read.
    Null or empty texts have no set and link with nothing; rows of equal doc_id are separate
    documents under one id; a null doc_id is never a component's smallest unless all are null.
    """
    return grouped(docs, block, dealt).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component (see `grouped`); of rows equal in doc_id and text one stays."""
    chosen = grouped(docs).where("chosen").select(F.col("doc_id").alias("__quern_id"), F.col("hash").alias("__quern_chosen"))
    kept = docs.withColumn("__quern_hash", F.xxhash64("text")).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("__quern_id")) & (F.col("__quern_hash") == F.col("__quern_chosen")), "left_semi"
    )
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if n.ids + min(n.nulls, 1) < n.rows:
        kept = kept.dropDuplicates(["doc_id", "__quern_hash"])
    return kept.drop("__quern_hash")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


OP5_SQL = r"""WITH RECURSIVE
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
