"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, stored

#: Links that a task holds at once (16 bytes each); so many or fewer in all are one task's work, more take rounds.
HELD = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that join what the given links join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    hung = root != np.arange(len(nodes))
    return nodes[hung], nodes[root[hung]]


def _contracted(links: DataFrame, held: int) -> DataFrame:
    """The stars of each partition's links, of which a task holds a bounded number: as many links as nodes at the most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, size = [], [], 0
        for batch in batches:
            a.append(batch.column("a").to_numpy())
            b.append(batch.column("b").to_numpy())
            size += batch.num_rows
            if size > held:
                x, y = stars(np.concatenate(a), np.concatenate(b))
                a, b, size = [x], [y], len(x)
                if size > held // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
                    a, b, size = [], [], 0
        if size:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return links.where("a <> b").select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """node and component (the smallest node reachable) of every node in links (columns a, b).

    Each task first reduces its links to stars.  If `held` links or fewer are left, one more task
    of that bounded size ends the work.  Otherwise large-star and small-star steps alternate: each
    hangs a node's neighbours on its smallest neighbour, so the links end as stars around each
    component's smallest node.  Minima are partial aggregates and the joins can be split, so a hub
    does not gather its links in one task; each round is stored, so a lost executor costs that
    round alone.
    """
    now = stored(_contracted(links, held), "links")
    mark, few = None, now.count() <= held
    if few:
        old, now = now, stored(_contracted(now.coalesce(1), 2 * held), "links")
        discard(old)
    while not few:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "k")
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(down, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            down.select(F.col("k").alias("a"), F.col("m").alias("b"))
        ).distinct()
        old, now = now, stored(small, "links")
        discard(old)
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if (new.n, new.h) == mark:
            break
        mark = (new.n, new.h)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
