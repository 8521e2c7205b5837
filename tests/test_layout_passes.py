"""Layouts are measured over baskets of equal items once, whatever the number of layouts."""

import statistics

from pyspark.sql import functions as F

from quern.operators import layout


def shuffled_rows(frame):
    """Rows that the largest shuffle of a frame's plan wrote, once it ran."""
    frame.collect()
    plan, sizes = [frame._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        else:
            if name == "ShuffleExchangeExec":
                sizes.append(node.metrics().apply("shuffleRecordsWritten").value())
            kids = node.children()
            plan += [kids.apply(i) for i in range(kids.size())]
    return max(sizes)


def test_shuffles_do_not_grow_with_baskets_or_layouts(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("invoice_id"), F.explode(F.expr("transform(sequence(0, int(id % 3)), i -> concat('i', (id + i) % 12))")).alias("item"))
    got = layout.efforts(rows, layout.baselines(rows, 4))
    assert shuffled_rows(got) < 4000
    held = {}
    for r in rows.collect():
        held.setdefault(r.invoice_id, set()).add(r["item"])
    zones = {}
    for r in layout.baselines(rows, 4).collect():
        zones.setdefault(r.layout, {})[r["item"]] = r.zone
    for r in got.collect():
        counts = [len({zones[r.layout][i] for i in b}) for b in held.values()]
        assert r.baskets == 4000 and abs(r.mean_zones - statistics.mean(counts)) < 1e-12 and r.median_zones == statistics.median(counts)
        assert r.most_zones == max(counts) and abs(r.single_share - counts.count(1) / 4000) < 1e-12


def test_baskets_without_a_placed_item_do_not_count(spark):
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("2", "c"), ("3", "a")], "invoice_id string, item string")
    zones = spark.createDataFrame([("x", "a", 0), ("x", "b", 1), ("y", "c", 5)], "layout string, item string, zone long")
    got = {r.layout: (r.baskets, r.mean_zones, r.most_zones, r.single_share) for r in layout.efforts(rows, zones).collect()}
    assert got == {"x": (2, 1.5, 2, 0.5), "y": (1, 1.0, 1, 1.0)}
