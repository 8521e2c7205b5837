"""Zones: the greedy growth against a plain version, merging in rounds, and their measure."""

import random

import pytest

from quern.operators import layout


def greedy(counts, edges, capacity):
    near = {i: {} for i in counts}
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    free, out, zone = set(counts), {}, 0
    while free:
        members = [max(sorted(free), key=lambda i: (sum(near[i].values()), counts[i]))]
        free.discard(members[0])
        while len(members) < capacity and free:
            pull = {i: sum(near[i].get(m, 0.0) for m in members) for i in sorted(free)}
            best = max(pull, key=lambda i: pull[i])
            if pull[best] <= 0:
                best = max(sorted(free), key=lambda i: counts[i])
            members.append(best)
            free.discard(best)
        out |= dict.fromkeys(members, zone)
        zone += 1
    return out


def case(spark, seed, n=23):
    rng = random.Random(seed)
    names = [f"i{k:02}" for k in range(n)]
    baskets = [rng.sample(names, rng.randint(1, 6)) for _ in range(80)] + [names]
    items = spark.createDataFrame([(str(k), x) for k, b in enumerate(baskets) for x in b], "invoice_id string, item string")
    edges = [(a, b, rng.randint(1, 64) / 8) for i, a in enumerate(names[: n - 6]) for b in names[i + 1 : n - 6] if rng.random() < 0.2]
    counts = {x: sum(x in b for b in baskets) for x in names}
    return baskets, items, spark.createDataFrame(edges, "a string, b string, weight double"), edges, counts


@pytest.mark.parametrize("seed", range(4))
def test_grown_zones(spark, seed):
    _, items, frame, edges, counts = case(spark, seed)
    for capacity in (1, 4, 50):
        assert {r["item"]: r.zone for r in layout.affinity_zones(frame, items, capacity).collect()} == greedy(counts, edges, capacity)


def test_merged_zones_keep_to_their_capacity(spark):
    baskets, items, frame, edges, counts = case(spark, 9)
    got = {r["item"]: r.zone for r in layout.affinity_zones(frame, items, 4, most=5).collect()}
    sizes = [sum(z == k for z in got.values()) for k in set(got.values())]
    assert set(got) == set(counts) and max(sizes) <= 4 and set(got.values()) == set(range(len(sizes))) and len(sizes) <= 8
    a, b, _ = max(edges, key=lambda e: e[2])
    assert got[a] == got[b]
    pairs = spark.createDataFrame([("i00", "i01", 9.0), ("i02", "i03", 8.0), ("i01", "i02", 7.0), ("i04", "i05", 1.0)], frame.schema)
    two = {r["item"]: r.zone for r in layout.merged_zones(pairs, items, 2).collect()}
    assert two["i00"] == two["i01"] and two["i02"] == two["i03"] and two["i04"] == two["i05"] and max(list(two.values()).count(z) for z in two.values()) == 2


def test_evaluated(spark):
    rng = random.Random(3)
    names = [f"i{k:02}" for k in range(24)]
    rng.shuffle(names)
    groups = [names[k : k + 4] for k in range(0, 24, 4)]
    baskets = [rng.sample(groups[k % 6], 3) for k in range(200)]
    items = spark.createDataFrame([(str(k), x) for k, b in enumerate(baskets) for x in b], "invoice_id string, item string")
    edges = spark.createDataFrame([(min(a, b), max(a, b), 1.0) for g in groups for i, a in enumerate(g) for b in g[i + 1 :]], "a string, b string, weight double")
    got = layout.evaluated(items, layout.affinity_zones(edges, items, 4), 4).first()
    assert got.mean_zones == got.single_share == 1.0 and got.zones_used == 6 and got.random_mean > 1.5 and got.popularity_mean > 1.2 and got.verdict == "adds to popularity"
    poor = layout.evaluated(items, layout.random_zones(items, 4, 99), 4).first()
    assert poor.verdict != "adds to popularity" or poor.less_than_popularity > 0
    by = {r.layout: r.mean_zones for r in layout.efforts(items, layout.baselines(items, 4)).collect()}
    assert len(by) == 6 and got.random_mean == pytest.approx(sum(v for k, v in by.items() if k != "popularity") / 5)
