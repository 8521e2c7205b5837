import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import language


def brute_phrases(train, text):
    """Longest-match parse of a symbol sequence by searching the training sequence."""
    train, count, k = bytes(train), 0, 0
    text = bytes(text)
    while k < len(text):
        n = 0
        while k + n < len(text) and text[k : k + n + 1] in train:
            n += 1
        k += max(n, 1)
        count += 1
    return count


def test_parse_equals_search():
    rng = random.Random(1)
    train = language._symbols(pa.array(["".join(rng.choice("abc e") for _ in range(300))]))[0]
    texts = ["".join(rng.choice("abcde é") for _ in range(n)) for n in (0, 1, 5, 80, 700)]
    symbols, offsets = language._symbols(pa.array(texts))
    got = language.phrases([language.automaton(train)], symbols, offsets)[:, 0]
    assert got.tolist() == [brute_phrases(train, symbols[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def test_held_out_accuracy(spark):
    rows = language.op3_language(spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out and lang is not null").agg(F.count("*").alias("n"), F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("right")).first()
    assert held.n > 100 and held.right > 0.95
    got = rows.collect()
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_odd_texts_and_models(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34 ?!", "x"), (4, "Ünd das", "x"), (5, "the and " * 20_000, "x"), (5, "the and", "x")], "doc_id long, text string, score string")
    train = spark.createDataFrame([("the and of the end", "en"), ("und das ist der bär", "de"), (None, "en"), ("unlabelled", None)], "text string, lang string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, language.fit(train)).orderBy("doc_id").collect()]
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en"), (5, "en")] and got[0][2] == 0 and got[3][2] > 0.5
    assert {r.lang_pred for r in language.predict(docs, language.fit(train.limit(0))).collect()} == {"und"}
    assert {r.score for r in language.predict(docs.where("doc_id > 3"), language.fit(train.where("lang = 'en'"))).collect()} == {1.0}
    assert language.predict(docs.limit(0), language.fit(train)).count() == 0


def test_table_is_bounded():
    table = language.automaton(np.array([2, 3] * 50 + [4], np.uint8))
    assert len(table) <= 2 * 101 + 2 and table.dtype == np.int32
