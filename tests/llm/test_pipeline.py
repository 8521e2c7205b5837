import importlib.util
import pathlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import quality
from quern.llm.common import word_count


def load(name):
    spec = importlib.util.spec_from_file_location(name, pathlib.Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [*steps] == ["quality rules", "near duplicates", "benchmark decontamination", "source mix", "sharding"]

    judged = {r.doc_id: r for r in quality.measured(docs).collect()}
    first = steps["quality rules"](spark, docs, sf_dir).cache()
    expected = {d: r.cleaned if r.cleaned is not None else r.text for d, r in judged.items() if r.kept}
    assert dict(texts(first)) == expected and first.columns == docs.columns

    components = load("test_jaccard").brute(texts(first))
    second = steps["near duplicates"](spark, first, sf_dir).cache()
    assert sorted(d for d, _ in texts(second)) == sorted({c for _, _, c in components}) and second.columns == docs.columns

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hits = {d: load("test_decontaminate").brute(t, items) for d, t in texts(second)}
    third = steps["benchmark decontamination"](spark, second, sf_dir).cache()
    after = dict(texts(third))
    assert set(after) == {d for d, (n, hit, _) in hits.items() if 100 * hit <= 50 * n}
    split = load("test_decontaminate").split
    assert all(len(split(t)) == hits[d][0] - hits[d][1] for d, t in after.items())

    fourth = steps["source mix"](spark, third, sf_dir).cache()
    copies = Counter(d for d, _ in texts(fourth))
    words = {r.doc_id: r.n for r in third.select("doc_id", word_count(F.col("text")).alias("n")).collect()}
    assert set(copies) <= set(after) and max(copies.values()) <= 2
    total = sum(words.values())
    assert 0 <= 1.5 * total - sum(words[d] * n for d, n in copies.items()) <= max(words.values())

    last = steps["sharding"](spark, fourth, sf_dir).collect()
    assert Counter(r.doc_id for r in last) == copies
    n = len(last)
    assert sorted(r.slot * 24 + r.shard for r in last) == list(range(n))


def test_run_reads_nulls_and_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(1, None, None, None, None), (None, "", "en", None, 0), (2, "w " * 50, None, "s", 1)], docs.schema))
    for name, some in (("odd", odd), ("none", docs.limit(0))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0
