from itertools import combinations

from pyspark.sql import functions as F

from quern.operators import rules


def test_triples_after_many_pairs(spark):
    """65 items in two equal baskets make 2,080 frequent pairs; every triple is frequent too."""
    baskets = spark.range(2).select(F.col("id").alias("invoice_id"), F.explode(F.sequence(F.lit(100), F.lit(164))).alias("item")).withColumn("item", F.col("item").cast("string"))
    got = rules.itemsets(baskets, 0.5, 3)
    triples = [tuple(r["items"]) for r in got.where("length = 3 and freq = 2").collect()]
    assert got.where("length = 2").count() == 2_080
    assert sorted(triples) == list(combinations([str(k) for k in range(100, 165)], 3))
