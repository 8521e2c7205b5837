"""Ward clustering of any number of points: tasks merge blocks of space as far as nothing outside can matter, in rounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.stage import stored

#: Clusters that are merged in one block; the result does not depend on it.
LEAVES = 2000
#: Parts that a pass cuts a block into at most, tasks of a round at most, and the share of clusters left by a round that makes the next one's blocks larger.
WAYS, TASKS, SLOW = 16, 256, 0.8
#: Costs in a table (which should stay in a core's cache), and the share of clusters in pairs below which pairs are looked for one by one.
CELLS, FEW = 50_000, 0.02


def _nearest(n: np.ndarray, centre: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster nearest to each of some clusters and the cost of their merge, from tables of CELLS costs at a time."""
    near, least, step = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf), max(1, CELLS // max(1, len(n)))
    for i in range(0, len(rows), step):
        some = rows[i : i + step]
        cost = sum((x[some, None] - x) ** 2 for x in centre.T) * (n[some, None] * n / (n[some, None] + n))
        cost[np.arange(len(some)), some] = np.inf
        near[i : i + step] = cost.argmin(1)
        least[i : i + step] = cost.min(1)
    return near, least


def chains(n: np.ndarray, centre: np.ndarray, outside: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int, float]]:
    """Ward's merges of weighted centres as (kept, absorbed, cost), children first: the rise of the sum of squares.

    Pairs that are nearest to each other merge in any order to the same tree, so no step looks for
    the least cost over all pairs: while such pairs are many they merge at once, then chains of
    nearest neighbours find them.  outside(n, centre) bounds from below the cost of merging clusters
    with any that is not given: a cluster whose nearest may lie there is left as it is, and so are
    those whose nearest it is.
    """
    n, centre, name, level, out = n.astype(float), centre.astype(float), np.arange(len(n)), np.zeros(len(n)), []
    bound = outside or (lambda weights, _: np.full(len(weights), np.inf))
    reach = bound(n, centre)
    near, cost = _nearest(n, centre, name)
    while True:
        sure, here = cost < reach, np.arange(len(n))
        a = np.flatnonzero((near[near] == here) & sure & sure[near] & (here < near))
        if len(a) <= FEW * len(n):
            break
        b = near[a]
        level[a] = np.maximum(cost[a], np.maximum(level[a], level[b]))  # no less than what it is made of, in spite of rounding
        out += zip(name[a].tolist(), name[b].tolist(), level[a].tolist())
        centre[a] = (n[a, None] * centre[a] + n[b, None] * centre[b]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        reach[a] = bound(n[a], centre[a])
        kept, merged = np.ones(len(n), bool), np.zeros(len(n), bool)
        kept[b], merged[a], merged[b] = False, True, True
        rows = np.flatnonzero((merged | merged[near])[kept])  # the others' nearest are as they were
        near = (np.cumsum(kept) - 1)[near][kept]
        n, centre, name, level, cost, reach = n[kept], centre[kept], name[kept], level[kept], cost[kept], reach[kept]
        near[rows], cost[rows] = _nearest(n, centre, rows)
    axes, alive, free, chain = [x.copy() for x in centre.T], np.ones(len(n), bool), cost < reach, []
    while chain or free.any():
        if not chain:
            chain = [int(free.argmax())]
        last = chain[-1]
        cost = sum((x - x[last]) ** 2 for x in axes) * (n[last] * n / (n[last] + n))
        cost[last] = np.inf
        near = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
            near = chain[-2]
        if not free[near] or cost[near] >= reach[last]:
            free[chain] = False
            chain = []
        elif len(chain) == 1 or near != chain[-2]:
            chain.append(near)
        else:
            a, b = min(near, last), max(near, last)
            level[a] = max(cost[near], level[a], level[b])
            out.append((int(name[a]), int(name[b]), float(level[a])))
            for x in axes:
                x[a], x[b] = (n[a] * x[a] + n[b] * x[b]) / (n[a] + n[b]), np.inf
            n[a] += n[b]
            reach[a] = bound(n[a : a + 1], np.array([[x[a] for x in axes]]))[0]
            alive[b] = free[b] = False
            chain = [c for c in chain[:-2] if alive[c]]
            if 2 * alive.sum() < len(alive):
                place = np.cumsum(alive) - 1
                chain = [int(place[c]) for c in chain]
                n, axes, name, level, reach, free = n[alive], [x[alive] for x in axes], name[alive], level[alive], reach[alive], free[alive]
                alive = alive[alive]
    return out


def merges(n: np.ndarray, centre: np.ndarray) -> list[tuple[int, int, float]]:
    """All of Ward's merges by increasing cost."""
    return sorted(chains(n, centre), key=lambda x: x[2])


def _roots(count: int, pairs: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """The first leaf of each leaf's cluster."""
    parent = list(range(count))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(count)], np.int64)


def cut(n: np.ndarray, centre: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers from 0, by first leaf, when k clusters are left."""
    return np.unique(_roots(len(n), merges(n, centre)[: max(0, len(n) - k)]), return_inverse=True)[1]


def _cuts(block, axes: Sequence[str], leaves: int) -> tuple[str, list[float]] | None:
    """The axis and the values at which a block of too many clusters is cut; none where they are all at one place."""
    axis = max(axes, key=lambda x: block[f"hi{x}"] - block[f"lo{x}"])
    lo, hi = block[f"lo{axis}"], block[f"hi{axis}"]
    if not lo < hi:
        return None
    ways = min(WAYS, max(2, math.ceil((1.4 * block.clusters / leaves) ** (1 / len(axes)))))
    at = sorted({block[f"q{axis}"][round(WAYS * i / ways) - 1] for i in range(1, ways)})
    middle = lo + (hi - lo) / 2
    return axis, [x for x in at if x < hi] or [middle if middle < hi else lo]


def _blocked(now: DataFrame, axes: Sequence[str], leaves: int) -> tuple[DataFrame, list]:
    """Clusters with the number of their block of space, and a row for each block: its box, clusters and least weight.

    Blocks are cut at quantiles of their longest side until they hold at most `leaves` clusters.  Only the blocks' rows,
    one for hundreds of clusters, are seen by the driver.
    """
    rows, used = now.withColumn("block", F.lit(0).cast("long")), 1
    places = F.array(*[F.lit(i / WAYS) for i in range(1, WAYS)])
    while True:
        found = rows.groupBy("set", "block").agg(
            F.count("*").alias("clusters"), F.min("n").alias("least"), *[F.min(x).alias(f"lo{x}") for x in axes], *[F.max(x).alias(f"hi{x}") for x in axes],
            *[F.percentile_approx(x, places, 200).alias(f"q{x}") for x in axes]).collect()
        cuts = []
        for block in found:
            how = _cuts(block, axes, leaves) if block.clusters > leaves else None
            if how:
                cuts.append((block.set, block.block, used, *how))
                used += WAYS
        if not cuts:
            return rows, found
        table = now.sparkSession.createDataFrame(cuts, "set long, block long, base long, axis string, at array<double>")
        value = F.coalesce(*[F.when(F.col("axis") == x, F.col(x)) for x in axes])
        part = F.size(F.filter("at", lambda a: a < value))
        rows = rows.join(F.broadcast(table), ["set", "block"], "left").withColumn("block", F.when(F.col("base").isNull(), F.col("block")).otherwise(F.col("base") + part)).drop("base", "axis", "at")


def _round(now: DataFrame, k: int, names: Sequence[str], leaves: int, seed: int) -> tuple[DataFrame, int]:
    """(set, id, root, n, names) of every cluster and of what it is merged into, and the number of blocks.

    A merge is done if nothing outside the block can be nearer, and k - 1 others of the block cost as much: so it belongs to
    the tree of the whole set, and not to the merges that the cut at k undoes.  Axes are turned by each round, so that
    sides of blocks lie elsewhere.
    """
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(names),) * 2))[0]
    axes = [f"_{i}" for i in range(len(names))]
    turned = now.select("*", *[sum((F.lit(float(w)) * F.col(x) for w, x in zip(row, names)), F.lit(0.0)).alias(a) for row, a in zip(turn, axes)])
    rows, blocks = _blocked(turned, axes, leaves)
    table = {s: [b for b in blocks if b.set == s] for s in {b.set for b in blocks}}
    boxes = {s: tuple(np.array(v, float) for v in ([b.block for b in own], [b.least for b in own], [[b[f"lo{x}"] for x in axes] for b in own], [[b[f"hi{x}"] for x in axes] for b in own])) for s, own in table.items()}

    def run(key: tuple[int, int], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        number, least, lo, hi = boxes[key[0]]
        others = number != key[1]
        least, lo, hi = least[others], lo[others], hi[others]
        slack = 1e-12 * max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))

        def outside(n: np.ndarray, centre: np.ndarray) -> np.ndarray:
            out, step = np.empty(len(n)), max(1, CELLS // len(least))
            for i in range(0, len(n), step):
                some, here = n[i : i + step, None], centre[i : i + step] @ turn.T
                gaps = (np.maximum(np.maximum(low - x[:, None], x[:, None] - high) - slack, 0.0) for x, low, high in zip(here.T, lo.T, hi.T))
                out[i : i + step] = (some * least / (some + least) * sum(gap**2 for gap in gaps)).min(1) * (1 - 1e-9)
            return out

        n, centre = pdf["n"].to_numpy(float), pdf[list(names)].to_numpy(float)
        done = sorted(chains(n, centre, outside if len(least) else None), key=lambda x: x[2])
        root = _roots(len(n), done[: max(0, len(done) - (k - 1))])
        weight = np.bincount(root, n, len(n))[root]
        means = {x: np.where(weight == n, centre[:, i], np.bincount(root, n * centre[:, i], len(n))[root] / weight) for i, x in enumerate(names)}
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"set": key[0], "id": ids, "root": ids[root], "n": weight, **means})

    shape = "set long, id long, root long, n double, " + ", ".join(f"`{x}` double" for x in names)
    made = rows.repartition(min(len(blocks), TASKS), "set", "block").groupBy("set", "block").applyInPandas(run, shape)
    return stored(made, "merged"), len(blocks)


def ward_each(frames: dict[int, DataFrame], k: int, features: Sequence[str], leaves: int = LEAVES) -> dict[int, DataFrame]:
    """`ward` of each of a handful of tables on its own, which share their rounds."""
    names = [f"x_{c}" for c in features]
    rows = {s: stored(points, "points") for s, points in frames.items()}
    points = reduce(DataFrame.union, [one.select(F.lit(s).cast("long").alias("set"), *names) for s, one in rows.items()])
    leaf = stored(points.groupBy("set", *names).agg(F.count("*").cast("double").alias("n")).orderBy("set", *names).withColumn("id", F.monotonically_increasing_id()), "leaves")
    now, links, before = leaf, [], {}
    while True:
        left = {r.set: r.clusters for r in now.groupBy("set").agg(F.count("*").alias("clusters")).collect()}
        if all(c <= k for c in left.values()):
            break
        if any(c > leaves and c > SLOW * before.get(s, math.inf) for s, c in left.items()):
            leaves *= 2
        made, blocks = _round(now, k, names, leaves, len(links))
        links.append(made.select("set", "id", "root"))
        now, before = made.where("id = root"), left
    labels = now.select("set", "id", (F.row_number().over(Window.partitionBy("set").orderBy("id")) - 1).cast("long").alias("cluster"))
    for link in reversed(links):
        labels = link.join(labels.withColumnRenamed("id", "root"), ["set", "root"]).select("set", "id", "cluster")
    named = stored(leaf.join(labels, ["set", "id"]).select("set", *names, "cluster"), "labels")
    return {s: one.join(named.where(F.col("set") == s).drop("set"), names).select(*one.columns, "cluster") for s, one in rows.items()}


def ward(points: DataFrame, k: int, features: Sequence[str], leaves: int = LEAVES) -> DataFrame:
    """points with cluster, from 0 in the order of their least point: merges that raise the sum of squares least, until k clusters are left.

    The tree is exact for any number of points.  A round cuts space into blocks of at most `leaves`
    clusters and merges, within each, what is nearer to each other than anything outside can be; what
    is left goes to the next round, and a set of one block is merged to the end.  Blocks grow where
    a round gets nowhere, so the rounds end.  Points with a null feature are not allowed; equal
    points share a cluster; an empty table stays empty.
    """
    return ward_each({0: points}, k, features, leaves)[0]
