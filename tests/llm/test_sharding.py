import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import sharding


@pytest.mark.parametrize("total", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_one_to_one(total):
    got = sharding.permute(np.arange(total), total, 7)
    assert sorted(got.tolist()) == list(range(total))
    assert got[total // 2] == sharding.permute(np.array([total // 2]), total, 7)[0]
    if total > 100:
        assert (sharding.permute(np.arange(total), total, 8) != got).mean() > 0.9 and abs(np.corrcoef(got, np.arange(total))[0, 1]) < 0.2


def test_documents(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op2_shard(spark, sf_dir).collect()
    order = {d: k for k, d in enumerate(sorted(docs))}
    n = len(docs)
    expected = sharding.permute(np.arange(n), n, 7)
    for r in rows:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        assert r.slot * 24 + r.shard == expected[order[r.doc_id]]
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op2_shard(spark, sf_dir).collect()))


def test_nulls_repeats_clashing_names_and_empty_table(spark):
    rows = spark.createDataFrame([(None, "a", "x"), (None, "a", "x"), (1, None, "x"), (1, None, "x"), (2, "", None)], "doc_id long, text string, shard string")
    got = sharding.shard(rows, 2).collect()
    assert sorted(r.slot * 2 + r.shard for r in got) == [0, 1, 2, 3, 4] and Counter(r.text for r in got) == {"a": 2, None: 2, "": 1}
    assert sharding.shard(rows.limit(0)).count() == 0
