import hashlib

import pytest
from pyspark.sql import functions as F

from quern.llm import mixing
from quern.llm.common import word_count


def brute(rows, weights=(5, 2, 1), share=1.5, repeats=2, seed=17):
    """rows: (doc_id, source, size), each unlike the others. Targets by raising shares step by step, then one sorted queue."""
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    size = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    left, target, free = share * sum(size.values()), {}, list(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > repeats * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = repeats * size[s]
            left -= target[s]
            free.remove(s)
    stamps = []
    for s in sources:
        own = sorted((hashlib.md5(f"{seed}/{'null' if d is None else d}".encode()).hexdigest(), -1 if d is None else d, n) for d, x, n in rows if x == s)
        through = 0
        for h, d, n in own:
            through += n
            for c in range(repeats):
                stamps.append(((c * size[s] + through) / target[s] if target[s] else 0.0, s or "", h, d, c, n))
    used, taken = 0, {}
    for _, _, _, d, _, n in sorted(stamps):
        used += n
        taken[d] = taken.get(d, 0) + (n if used <= sum(target.values()) * (1 + 1e-12) else 0)
    return target, taken


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    target, taken = brute([tuple(r) for r in docs.collect()])
    got = mixing.op7_mix(spark, sf_dir).collect()
    assert {r.doc_id: r.taken for r in got} == taken and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(t, 6) for t in target.values()})
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op7_mix(spark, sf_dir).collect()))


def test_words(spark):
    texts = [None, "", "  ", "a", " a\tb\nc\x0bd\x0ce\rf ", "a\u00a0b c\u2003d"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", word_count(F.col("t")).alias("n"))
    assert [r.n for r in got.orderBy("k").collect()] == [0, 0, 0, 1, 6, 2]


def test_hot_and_odd_sources(spark):
    rows = [(k, "hot", 10) for k in range(300)] + [(1000 + k, "b", 3) for k in range(40)] + [(2000, None, 50), (2001, "empty", 0), (None, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    target, taken = brute(rows)
    got = mixing.decide(docs).collect()
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + r.copies * r.size
    assert all(abs(by[s] - t) <= 100 for s, t in target.items()) and sum(by.values()) <= 1.5 * 3177


def test_mix_repeats_rows_and_takes_the_empty_table(spark):
    docs = spark.createDataFrame([(k, "w " * 5, "s", "x") for k in range(20)] + [(1, "w " * 5, "s", "x"), (50, None, None, "y")], "doc_id long, text string, source string, size string")
    out = mixing.mix(docs, word_count(F.col("text")))
    assert out.columns == docs.columns and 28 <= out.count() <= 34
    assert mixing.mix(docs.limit(0), word_count(F.col("text"))).count() == 0 == mixing.decide(docs.limit(0).select("doc_id", "source", F.lit(1).cast("long").alias("size"))).count()


@pytest.mark.parametrize("weights", [(1,), (5, 2, 1)])
def test_plan_has_no_python(spark, sf_dir, weights):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    plan = mixing.decide(docs, weights=weights)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
