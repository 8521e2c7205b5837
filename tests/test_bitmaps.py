"""Itemsets by bitmaps against sets counted one by one."""

import random
from collections import Counter
from itertools import combinations
from math import ceil

import pytest

from quern.operators import bitmaps, rules


def brute(baskets, support, longest):
    least, counts = ceil(support * len(baskets)), Counter()
    for b in baskets:
        for k in range(1, longest + 1):
            counts.update(combinations(sorted(b), k))
    return sorted((s, n) for s, n in counts.items() if n >= least)


def frame(spark, baskets):
    return spark.createDataFrame([(f"i{k}", x) for k, b in enumerate(baskets) for x in b], "invoice_id string, item string").repartition(3)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_against_counting(spark, block, monkeypatch):
    monkeypatch.setattr(bitmaps, "CHUNK", 5)
    rng = random.Random(block)
    baskets = [set(rng.choices("abcdefghij", weights=range(1, 11), k=rng.randint(1, 9))) for _ in range(150)]
    got = bitmaps.itemsets(frame(spark, baskets), 0.08, 4, block).collect()
    assert sorted((tuple(r.items), r.freq) for r in got) == brute(baskets, 0.08, 4) and {r.baskets for r in got} == {150} and all(r.length == len(r.items) for r in got)


def test_a_basket_of_two_thousand_items(spark):
    """Its pairs are counted as bits; its 1.3 thousand million triples are never made."""
    rng = random.Random(1)
    large = [f"x{k:04}" for k in range(2000)]
    baskets = [set(large)] + [set(rng.sample(large, 3)) | {"a", "b", "c"} for _ in range(60)]
    got = {tuple(r.items): r.freq for r in rules.itemsets(frame(spark, baskets), 0.5, 3).collect()}
    assert got == {("a",): 60, ("b",): 60, ("c",): 60, ("a", "b"): 60, ("a", "c"): 60, ("b", "c"): 60, ("a", "b", "c"): 60}
    pairs = rules.itemsets(frame(spark, [set(large), set(large)]), 1.0, 2)
    assert pairs.where("length = 2").count() == 2000 * 1999 // 2


def test_candidates_need_all_subsets(spark):
    sets = spark.createDataFrame([([1, 2],), ([1, 3],), ([2, 3],), ([1, 4],), ([2, 4],)], "nos array<bigint>")
    assert sorted(tuple(r.nos) for r in bitmaps.candidates(sets, 3).collect()) == [(1, 2, 3), (1, 2, 4)]


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "invoice_id string, item string")
    assert bitmaps.itemsets(none).count() == 0
    some = spark.createDataFrame([("1", None), (None, "a"), ("1", "a"), ("1", "b")], "invoice_id string, item string")
    assert sorted(tuple(r.items) for r in bitmaps.itemsets(some, 1.0).collect()) == [("a",), ("a", "b"), ("b",)]
