"""How many clusters: fits of k-means over a range of k, quality indices over all points, and the gap statistic."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.reports import silhouette
from quern.operators.segments import FEATURES, elbow, quality
from quern.sources.stage import discard, stored

Centres = list[list[float]]


def _from_centres(count: int) -> Column:
    """Squared distances of v to each of `centres`; v has `count` values."""
    return F.transform("centres", lambda c: sum((F.pow(c[i] - F.col("v")[i], F.lit(2.0)) for i in range(count)), F.lit(0.0)))


#: Points whose distances to all centres are in memory at once.
CHUNK = 2048


def _values(batch: pa.RecordBatch, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers and points of a batch."""
    return batch.column("set").to_numpy(), np.column_stack([batch.column(f"v{i}").to_numpy(zero_copy_only=False) for i in range(count)])


def _first(batches: Iterator[pa.RecordBatch], count: int, starts: int, most: int) -> Iterator[pa.RecordBatch]:
    """(set, start, h, v0, ...): a task's different points of the `most` smallest hashes of each set and start."""
    kept: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        sets, points = _values(batch, count)
        for start in range(starts):
            h = batch.column(f"h{start}").to_numpy()
            for s in np.unique(sets):
                mine = np.flatnonzero(sets == s)
                own = np.rec.fromarrays([h[mine], *points[mine].T])
                if (s, start) in kept:
                    own = np.concatenate([kept[s, start], own])
                nth = np.unique(own["f0"])[:most][-1]
                kept[s, start] = np.unique(own[own["f0"] <= nth])
    for (s, start), own in kept.items():
        n = len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s, np.int64)), pa.array(np.full(n, start, np.int64)), *[pa.array(own[f"f{i}"]) for i in range(count + 1)]],
                                         names=["set", "start", "h", *[f"v{i}" for i in range(count)]])


def _moved(batches: Iterator[pa.RecordBatch], centres: dict[tuple[int, int, int], Centres], count: int) -> Iterator[pa.RecordBatch]:
    """(set, start, k, c, n, cost, v0, ...): a task's points and their sums by the nearest centre (the first of equals) of each fit."""
    by_set: dict[int, list[tuple[int, int]]] = {}
    for s, t, k in sorted(centres):
        by_set.setdefault(s, []).append((t, k))
    held = {s: np.concatenate([np.asarray(centres[s, t, k], float) for t, k in own]) for s, own in by_set.items()}
    ends = {s: np.cumsum([0, *[len(centres[s, t, k]) for t, k in own]]) for s, own in by_set.items()}
    sums = {s: np.zeros((len(c), count + 2)) for s, c in held.items()}
    for batch in batches:
        sets, points = _values(batch, count)
        for s in np.unique(sets):
            mine = points[sets == s]
            for low in range(0, len(mine), CHUNK):
                part = mine[low : low + CHUNK]
                d = sum((held[s][:, i, None] - part[None, :, i]) ** 2 for i in range(count))
                for a, b in zip(ends[s], ends[s][1:], strict=False):
                    c, size = d[a:b].argmin(0), b - a
                    weights = [None, d[a:b].min(0), *part.T]
                    for j, w in enumerate(weights):
                        sums[s][a:b, j] += np.bincount(c, w, size)
    rows = [(s, t, k, j - a, *sums[s][j]) for s, own in by_set.items() for (t, k), a, b in zip(own, ends[s], ends[s][1:], strict=False) for j in range(a, b) if sums[s][j][0]]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["set", "start", "k", "c", "n", "cost", *[f"v{i}" for i in range(count)]])


def fits(sets: DataFrame, ks: Sequence[int], count: int, starts: int = 3, rounds: int = 20, seed: int = 17) -> dict[tuple[int, int], tuple[float, Centres]]:
    """(set, k): least within sum of squares of several starts, and its centres.  sets: set, v (array of `count` values).

    Lloyd's rounds of all sets, starts and k run together: a task adds up its points by the nearest
    centre of every fit, and an aggregate over the tasks' sums moves the centres, so a round is one
    job whatever the number of fits.  Starts are the points of smallest seeded hash; equal points
    start one cluster.  A cluster without points keeps its centre.  Rounds end where no sum falls by
    over a millionth.
    """
    names, most = [f"v{i}" for i in range(count)], max(ks)
    points = stored(sets.select("set", *[F.col("v")[i].alias(x) for i, x in enumerate(names)]), "sets")
    hashed = points.select("set", *names, *[F.xxhash64(F.lit(seed), F.lit(t), F.array(*names)).alias(f"h{t}") for t in range(starts)])
    values = ", ".join(f"{x} double" for x in names)
    drawn = hashed.mapInArrow(lambda batches: _first(batches, count, starts, most), f"set long, start long, h long, {values}").distinct()
    first = drawn.withColumn("n", F.row_number().over(Window.partitionBy("set", "start").orderBy("h", *names))).where(F.col("n") <= most)
    begun: dict[tuple[int, int], Centres] = {}
    for r in first.orderBy("set", "start", "n").collect():  # sets x starts x the largest k
        begun.setdefault((r.set, r.start), []).append([r[x] for x in names])
    centres = {(s, t, k): held[:k] for (s, t), held in begun.items() for k in ks}
    costs: dict[tuple[int, int, int], float] = {}
    for _ in range(rounds):
        moved = points.mapInArrow(lambda batches, held=centres: _moved(batches, held, count), f"set long, start long, k long, c long, n double, cost double, {values}")
        now, after = dict.fromkeys(centres, 0.0), {key: list(held) for key, held in centres.items()}
        for r in moved.groupBy("set", "start", "k", "c").agg(*[F.sum(x).alias(x) for x in ("n", "cost", *names)]).collect():  # a row for each cluster
            key = (r.set, r.start, r.k)
            now[key] += r.cost
            after[key][r.c] = [r[x] / r.n for x in names]
        settled = all(key in costs and costs[key] - now[key] <= 1e-6 * costs[key] for key in now)
        costs, centres = now, after
        if settled:
            break
    discard(points)
    best: dict[tuple[int, int], tuple[float, Centres]] = {}
    for (s, t, k), cost in sorted(costs.items()):
        if (s, k) not in best or cost < best[s, k][0]:
            best[s, k] = (cost, centres[s, t, k])
    return best


def silhouette_squared(rows: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row: points and mean silhouette by squared distances, exact over all points.

    The mean squared distance of a point to a cluster follows from the cluster's size, mean and sum
    of squares, so a point meets one small array; a point alone in its cluster counts 0.
    """
    names = [f"x_{c}" for c in features]
    norm = sum((F.pow(F.col(x), F.lit(2.0)) for x in names), F.lit(0.0))
    by = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(norm).alias("q"), *[F.avg(x).alias(f"m_{x}") for x in names])
    every = by.agg(F.collect_list(F.struct("cluster", "n", "q", *[f"m_{x}" for x in names])).alias("clusters"))  # as many as clusters
    away = lambda c: norm + c["q"] - 2 * sum((F.col(x) * c[f"m_{x}"] for x in names), F.lit(0.0))
    met = rows.select("cluster", *names).join(F.broadcast(every))
    own = F.element_at(F.filter("clusters", lambda c: c["cluster"] == F.col("cluster")), 1)
    near = F.array_min(F.transform(F.filter("clusters", lambda c: c["cluster"] != F.col("cluster")), away))
    judged = met.select(own["n"].alias("n"), (away(own) * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), near.alias("b"))
    value = F.when((F.col("n") > 1) & F.col("b").isNotNull(), F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).otherwise(0.0)
    return judged.agg(F.count("*").alias("points"), F.avg(value).alias("silhouette_squared"))


def reading(silhouette: Column) -> Column:
    """Words for a silhouette: well separated from 0.5 on, overlapping from 0.25 on, else little separation."""
    return F.when(silhouette >= 0.5, "well separated").when(silhouette >= 0.25, "overlapping").otherwise("little separation")


def gaps(costs: dict[tuple[int, int], float], ks: Iterable[int], references: int) -> tuple[list[tuple[int, float, float]], int | None]:
    """(k, gap, standard error) from the sums of squares of set 0 and of the reference sets, and the k chosen.

    The smallest k whose gap reaches the next one's less its error; None where the gap never stops rising.
    """
    floored = lambda s, k: math.log(max(costs[s, k], 1e-12))
    out = []
    for k in sorted(ks):
        logs = [floored(s, k) for s in range(1, references + 1)]
        mean = sum(logs) / references
        spread = math.sqrt(sum((x - mean) ** 2 for x in logs) / (references - 1)) if references > 1 else 0.0
        out.append((k, mean - floored(0, k), spread * math.sqrt(1 + 1 / references)))
    chosen = next((a[0] for a, b in zip(out, out[1:], strict=False) if a[1] >= b[1] - b[2]), None)
    return out, chosen


def compared(points: DataFrame, features: Sequence[str] = FEATURES, least: int = 2, most: int = 8, references: int = 10, starts: int = 3, seed: int = 17) -> DataFrame:
    """A row for each k: indices, gap with its error, smallest cluster's share, which measures prefer this k, and the silhouette in words.

    References are as many uniform points as rows in the box of the data.  Measures may disagree;
    no single k is returned.  k stays below the number of different points; without such k, or on
    an empty table, there are no rows.
    """
    spark = points.sparkSession
    names = [f"x_{c}" for c in features]
    data = stored(points.select(*names), "data")
    box = data.agg(F.count("*").alias("n"), F.count_distinct(*names).alias("different"), *[F.min(x).alias(f"lo_{x}") for x in names], *[F.max(x).alias(f"hi_{x}") for x in names]).first()
    ks = [k for k in range(least, most + 1) if k < box.different]
    schema = "k long, within double, calinski_harabasz double, davies_bouldin double, silhouette double, silhouette_squared double, smallest_share double, gap double, gap_error double, preferred_by array<string>"
    if not ks:
        return spark.createDataFrame([], schema).withColumn("reading", F.lit(None).cast("string"))
    own = data.select(F.lit(0).cast("long").alias("set"), F.array(*names).alias("v"))
    sets = own
    for s in range(1, references + 1):
        drawn = [box[f"lo_{x}"] + F.rand(seed + 100 * s + i) * (box[f"hi_{x}"] - box[f"lo_{x}"]) for i, x in enumerate(names)]
        sets = sets.union(spark.range(box.n).select(F.lit(s).cast("long").alias("set"), F.array(*drawn).alias("v")))
    found = fits(sets, ks, len(names), starts, seed=seed)
    gap, by_gap = gaps({key: cost for key, (cost, _) in found.items()}, ks, references)
    rows = []
    for k in ks:
        centres = F.array(*[F.array(*map(F.lit, c)) for c in found[0, k][1]])
        labelled = stored(data.withColumn("v", F.array(*names)).withColumn("centres", centres).withColumn("d", _from_centres(len(names)))
                          .select(*names, F.array_position("d", F.array_min("d")).alias("cluster")), "labelled")
        index = quality(labelled, features).first()
        sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first().n
        rows.append((k, found[0, k][0], index.calinski_harabasz, index.davies_bouldin, silhouette(labelled, features).first().silhouette, silhouette_squared(labelled, features).first().silhouette_squared, sizes / box.n))
        discard(labelled)
    best = lambda at, sign: max(rows, key=lambda r: (sign * r[at] if r[at] is not None else -math.inf, -r[0]))[0]
    prefers = {"calinski_harabasz": best(2, 1), "davies_bouldin": best(3, -1), "silhouette": best(4, 1), "elbow": elbow({r[0]: r[1] for r in rows})[0], "gap": by_gap}
    full = [(*r, g[1], g[2], [name for name, k in prefers.items() if k == r[0]]) for r, g in zip(rows, gap, strict=True)]
    return spark.createDataFrame(full, schema).withColumn("reading", reading(F.col("silhouette")))
