"""A task's part of a fit against plain versions."""

import numpy as np
import pyarrow as pa

from quern.operators import choice


def batches(rng):
    for n in (1, 700, 3000):
        points = rng.integers(0, 40, (n, 2)).astype(float)
        sets = rng.integers(0, 2, n)
        h = [[hash((t, int(s), *map(float, p))) for s, p in zip(sets, points)] for t in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(sets), *map(pa.array, points.T.copy()), *[pa.array(x, pa.int64()) for x in h]], names=["set", "v0", "v1", "h0", "h1"])


def test_sums_by_the_nearest_centre():
    given = list(batches(np.random.default_rng(4)))
    rows = [(s, a, b) for x in given for s, a, b in zip(*[x.column(c).to_pylist() for c in ("set", "v0", "v1")])]
    centres = {(s, t, k): [[3.0 * t + 9 * i, 5.0 * i + s] for i in range(k)] for s in (0, 1) for t in (0, 1) for k in (2, 3)}
    expected = {}
    for s, a, b in rows:
        for (of, t, k), held in centres.items():
            if of == s:
                d = [(a - x) ** 2 + (b - y) ** 2 for x, y in held]
                c = d.index(min(d))
                one = expected.setdefault((s, t, k, c), np.zeros(4))
                one += (1, d[c], a, b)
    got = {tuple(r[:4]): r[4:] for x in choice._moved(iter(given), centres, 2) for r in zip(*[x.column(i).to_pylist() for i in range(8)])}
    assert set(got) == set(expected) and all(np.allclose(got[key], expected[key]) for key in got)
    assert list(choice._moved(iter([]), centres, 2)) == []


def test_points_of_smallest_hash():
    given = list(batches(np.random.default_rng(5)))
    got = {(x.column("set")[0].as_py(), x.column("start")[0].as_py()): list(zip(*[x.column(c).to_pylist() for c in ("h", "v0", "v1")])) for x in choice._first(iter(given), 2, 2, 5)}
    for (s, t), held in got.items():
        rows = {r[1:] for x in given for r in zip(*[x.column(c).to_pylist() for c in ("set", f"h{t}", "v0", "v1")]) if r[0] == s}
        assert sorted(held) == sorted(rows)[:5]
    assert len(got) == 4
