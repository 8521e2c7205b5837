"""Gaussian mixtures: the rounds of several sets of points and several starts run together."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.stage import discard, stored

#: As in Spark's GaussianMixture: the floor of a component's weighted density, the most rounds, and the change of the log-likelihood that ends them.
EPSILON, ROUNDS, TOLERANCE = 2.0**-52, 100, 0.01
#: Points of a start's component, as there.
DRAWN = 5
#: Points whose densities are in memory at once.
CHUNK = 2048


class Mixture(NamedTuple):
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def densities(self) -> tuple[np.ndarray, np.ndarray]:
        """Roots of the inverse covariances (pseudo-inverses where singular), and the logarithm of each weighted density at its mean."""
        values, vectors = np.linalg.eigh(self.covariances)
        kept = values > EPSILON * values.max(1, keepdims=True) * values.shape[1]
        if not kept.any(1).all():
            raise ValueError("a component has no spread at all")
        safe = np.where(kept, values, 1.0)
        roots = (kept / np.sqrt(safe))[:, :, None] * vectors.transpose(0, 2, 1)
        with np.errstate(divide="ignore"):
            return roots, np.log(self.weights) - 0.5 * (values.shape[1] * math.log(2 * math.pi) + np.log(safe).sum(1))


def begun(rows: DataFrame, k: int, starts: int, seed: int, names: Sequence[str]) -> list[Mixture]:
    """The starts of Spark's GaussianMixture, from one seed after the other: means and spreads of `DRAWN` random points a component."""
    out, points = [], rows.select(*names).persist()
    for s in range(starts):
        drawn = points._jdf.javaRDD().takeSample(True, k * DRAWN, seed + s)
        slices = np.array([[r.getDouble(i) for i in range(len(names))] for r in drawn]).reshape(k, DRAWN, len(names))
        out.append(Mixture(np.full(k, 1 / k), slices.mean(1), np.array([np.diag(v) for v in slices.var(1)])))
    points.unpersist()
    return out


def _packed(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """(set, points): a batch's points of a set as one array of doubles, a feature after the other."""
    for batch in batches:
        sets, points = batch.column("set").to_numpy(), np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in names])
        for s in np.unique(sets):
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.ascontiguousarray(points[:, sets == s]).tobytes()])], names=["set", "points"])


def _sums(batches: Iterator[pa.RecordBatch], models: dict[tuple[int, int], Mixture], d: int) -> Iterator[pa.RecordBatch]:
    """(set, start, c, likelihood, n, v0, ..., q0, ...): a task's shares of each component of each fit, and their sums of values and products.

    The log-likelihood of a fit stands with its first component.
    """
    upper = np.triu_indices(d)
    by_set: dict[int, list[int]] = {}
    for s, t in sorted(models):
        by_set.setdefault(s, []).append(t)
    held, sums = {}, {}
    for s, own in by_set.items():
        roots, tops = (np.concatenate(x) for x in zip(*[models[s, t].densities() for t in own], strict=True))
        means = np.concatenate([models[s, t].means for t in own])
        held[s] = roots.reshape(-1, d), np.einsum("cij,cj->ci", roots, means).reshape(-1, 1), tops[:, None]
        sums[s] = np.zeros((len(tops), 2 + d + len(upper[0])))
    for batch in batches:
        for s, points in zip(batch.column("set").to_pylist(), batch.column("points").to_pylist(), strict=True):
            if s not in held:
                continue
            mine, (roots, at, tops) = np.frombuffer(points).reshape(d, -1), held[s]
            for low in range(0, mine.shape[1], CHUNK):
                x = mine[:, low : low + CHUNK]
                n = x.shape[1]
                away = roots @ x
                away -= at
                away *= away
                p = EPSILON + np.exp(tops - 0.5 * away.reshape(-1, d, n).sum(1))
                p = p.reshape(len(by_set[s]), -1, n)
                whole = p.sum(1)
                p /= whole[:, None]
                sums[s][:: p.shape[1], 0] += np.log(whole).sum(1)
                sums[s][:, 1:] += p.reshape(-1, n) @ np.concatenate([np.ones((1, n)), x, x[upper[0]] * x[upper[1]]]).T
    rows = [(s, t, c, *sums[s][i * len(sums[s]) // len(own) + c]) for s, own in by_set.items() for i, t in enumerate(own) for c in range(len(sums[s]) // len(own)) if sums[s][:, 1].any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=_columns(d))


def _columns(d: int) -> list[str]:
    return ["set", "start", "c", "likelihood", "n", *[f"v{i}" for i in range(d)], *[f"q{i}" for i in range(d * (d + 1) // 2)]]


def fits(sets: DataFrame, starts: dict[tuple[int, int], Mixture], names: Sequence[str]) -> dict[int, tuple[float, Mixture]]:
    """set: log-likelihood and mixture of its best start.  sets: set (long), and a column for each of `names`; starts by (set, number).

    The rounds are those of Spark's GaussianMixture, for all sets and starts together: a task adds up
    its points' shares of every component, and an aggregate over the tasks' sums moves the
    components, so a round is one job whatever the number of fits.  Points are packed into arrays once,
    so that no round converts them row by row.  A fit whose log-likelihood
    settles takes no more rounds.
    """
    d, columns = len(names), _columns(len(names))
    upper = np.triu_indices(d)
    schema = ", ".join(f"{x} {'long' if x in ('set', 'start', 'c') else 'double'}" for x in columns)
    packed = stored(sets.select("set", *names).mapInArrow(lambda batches: _packed(batches, names), "set long, points binary"), "packed")
    models, likelihood = dict(starts), dict.fromkeys(starts, -math.inf)
    running = set(starts)
    for _ in range(ROUNDS):
        if not running:
            break
        wanted = {key: models[key] for key in running}
        shares = packed.mapInArrow(lambda batches, wanted=wanted: _sums(batches, wanted, d), schema)
        got: dict[tuple[int, int], list] = {}
        for r in shares.groupBy("set", "start", "c").agg(*[F.sum(x).alias(x) for x in columns[3:]]).collect():  # a row for each component
            got.setdefault((r.set, r.start), []).append(r)
        for key, parts in got.items():
            table = np.array([r[3:] for r in sorted(parts, key=lambda r: r.c)])
            n, means, products = table[:, 1], table[:, 2 : 2 + d] / table[:, 1:2], table[:, 2 + d :] / table[:, 1:2]
            covariances = np.zeros((len(n), d, d))
            covariances[:, upper[0], upper[1]] = products - means[:, upper[0]] * means[:, upper[1]]
            covariances[:, upper[1], upper[0]] = covariances[:, upper[0], upper[1]]
            before, likelihood[key] = likelihood[key], table[:, 0].sum()
            models[key] = Mixture(n / n.sum(), means, covariances)
            if abs(likelihood[key] - before) <= TOLERANCE:
                running.discard(key)
    discard(packed)
    best: dict[int, tuple[float, Mixture]] = {}
    for (s, t), value in sorted(likelihood.items()):
        if s not in best or value > best[s][0]:
            best[s] = (value, models[s, t])
    return best


def labelled(rows: DataFrame, model: Mixture, names: Sequence[str]) -> DataFrame:
    """rows with cluster: the component of the largest share (the first of equals)."""
    roots, tops = model.densities()
    density = []
    for root, mean, top in zip(roots.tolist(), model.means.tolist(), tops.tolist(), strict=True):
        away = [sum((F.lit(r) * (F.col(x) - F.lit(m)) for r, x, m in zip(line, names, mean, strict=True)), F.lit(0.0)) for line in root]
        density.append(F.lit(EPSILON) + F.exp(F.lit(top) - F.lit(0.5) * sum((a * a for a in away), F.lit(0.0))))
    shares = rows.withColumn("_p", F.array(*density))
    return shares.withColumn("cluster", F.array_position("_p", F.array_max("_p")) - 1).drop("_p")
