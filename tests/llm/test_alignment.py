import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import alignment


def spans(ids, spelt):
    place, out = 0, []
    for k in ids:
        out.append((place, place + len(spelt[k]), k))
        place += len(spelt[k])
    return out


def brute(texts):
    """Every text encoded whole, every pair of tokens compared by their byte ranges."""
    pair = alignment._pair(alignment.FOLDER, alignment.FIRST, alignment.SECOND)
    rows, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = pair.first.encode(" " + text, add_special_tokens=False).ids, pair.second.encode(text)
            if not b"".join(pair.a_bytes[k] for k in a) == (" " + text).encode() == b"".join(pair.b_bytes[k] for k in b):
                a = b = []
        first, second = spans(a, pair.a_bytes), spans(b, pair.b_bytes)
        cuts = sorted({x[1] for x in first} & {x[1] for x in second})
        inside = lambda part, lo, hi: ",".join(str(k) for s, e, k in part if lo <= s and e <= hi)
        groups = [f"{inside(first, lo, hi)}|{inside(second, lo, hi)}" for lo, hi in zip([0, *cuts], cuts)]
        links, at = [], 0
        for s, e, k in first:
            while at < len(second) and second[at][1] <= s:
                at += 1
            j = at
            while j < len(second) and second[j][0] < e:
                links.append((k, second[j][2]))
                j += 1
        counts.update(links)
        rows.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    top = {}
    for (_, b), c in counts.items():
        top[b] = max(top.get(b, 0), c)
    return [(n_a, n_b, n, len(x), sum(counts[y] == top[y[1]] for y in x), sum(counts[y] for y in x), g) for n_a, n_b, n, x, g in rows]


def got(spark, texts, **options):
    frame = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, _window int").repartition(3)
    rows = {r.doc_id: (*(r[c] for c in alignment.NUMBERS), r.groups) for r in alignment.align(frame, ["doc_id"], **options).collect()}
    return [rows[k] for k in range(len(texts))]


ODD = [
    None, "", " ", "  a b", "foo ", "foo  ", "a\n b  c  d é f", "日本語 テキスト 。 x", "<|endoftext|> </s> <s> a <unk>", "▁ x ▁y", "x\x00 y", "tab\t here  \n\n  z", "👍🏽 ok 🇩🇪",
    "n't we'll 's  don't", "ﬁ ½ Å x", "a" * 3000, "It's 12345 6 7.8", "﻿ q", "á ́b", "\r\n \r\n x", "x　y z", "q\u0085 z", "w  x", "word " * 4000, "foo ", "foo ",
]


def test_odd_texts(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(" \t\nab'1.é 日 ▁<>", k=rng.randint(1, 40))) for _ in range(300)]
    assert got(spark, texts) == brute(texts)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: x for d, x in zip(docs, brute([d.text for d in docs]))}
    for r in alignment.op13_align(spark, sf_dir).collect():
        assert tuple(r[c] for c in alignment.NUMBERS) == want[r.doc_id][:6]
        assert r.groups_sha256 == (hashlib.sha256(want[r.doc_id][6].encode()).hexdigest() if want[r.doc_id][0] else "")


def test_small_windows(spark, monkeypatch):
    monkeypatch.setattr(alignment, "WINDOW_BYTES", 40)
    assert got(spark, ODD) == brute(ODD)


def test_empty_table_null_ids_and_kept_columns(spark):
    assert got(spark, []) == []
    rows = [(None, "a b", 1, 7), (None, "a b", 1, 7), (2, None, 2, 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, pair int, count int")
    found = alignment.align(frame.selectExpr("*", "9 as n_a", "'x' as groups"), ["doc_id", "pair", "count", "n_a", "groups"]).collect()
    assert {(r.n_a, r.groups == "x") for r in found} == {(0, False), (2, False)}
    assert sorted((r.doc_id or 0, r.pair, r["count"], r.n_links, r.count_sum) for r in found) == [(0, 1, 7, 2, 4), (0, 1, 7, 2, 4), (2, 2, 8, 0, 0)]


@pytest.mark.parametrize("seed", range(20))
def test_terminals_are_components(seed):
    """Against a union of all overlapping pairs."""
    rng = random.Random(seed)
    size = rng.randint(1, 200)
    a, b = (np.array(sorted({size, *rng.choices(range(1, size + 1), k=rng.randint(0, size))})) for _ in range(2))
    first, second, far = alignment.terminals(a, b)
    cuts = sorted(set(a.tolist()) & set(b.tolist()))
    assert [b[k] for k in first] == [min(c for c in cuts if c >= e) for e in a] and [b[k] for k in second] == [min(c for c in cuts if c >= e) for e in b]
    assert all(b[k] >= e and (k == 0 or b[k - 1] < e) for k, e in zip(far, a))
