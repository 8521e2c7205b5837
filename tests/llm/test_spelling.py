import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quern.llm import spelling

ALPHA = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, damaged, least=5, count=3):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(ALPHA)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if damaged and h % damaged == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counted, ratio=2):
    near, forms = defaultdict(list), {}
    for a in counted:
        for b in counted:
            if abs(len(a) - len(b)) < 2 and a != b and one_apart(a, b):
                near[a].append(b)
    for w, n in counted.items():
        best = min(near[w], key=lambda x: (-counted[x], x)) if near[w] else None
        forms[w] = best if best and counted[best] >= ratio * n else None
    rows = []
    for w, n in counted.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, len(near[w]), counted[forms[w]] if forms[w] else None))
    return sorted(rows, key=str)


def got(frame):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()), key=str)


def test_random_words(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 7))): rng.randint(1, 60) for _ in range(500)}
    words |= {"aaaa": 9, "aaaaa": 30, "x" * 3000: 3, "x" * 2999: 7, "x" * 1500 + "y" + "x" * 1499: 80, "\U0001f600b": 2, "\U0001f600": 5, "￿b": 3}
    frame = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n long, id int").repartition(5)
    assert got(spelling.variants(frame)) == brute(words)


def test_trie_numbers_are_nodes(spark):
    rng = random.Random(5)
    keys = list({"".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(300)}) + ["b" * 500, "b" * 400 + "a"]
    found = {r.key: r.nodes for r in spelling.trie(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    number = {k[:d]: found[k][d] for k in keys for d in range(len(k) + 1)}
    assert all(number[k[:d]] == found[k][d] for k in keys for d in range(len(k) + 1))
    assert sorted(number.values()) == list(range(len(number)))
    assert [found[k][-1] for k in sorted(keys)] == sorted(found[k][-1] for k in keys)


@pytest.mark.parametrize("damaged", [0, 7, 97])
def test_vocabulary(spark, damaged):
    rng = random.Random(damaged)
    rows = [(k, " ".join("".join(rng.choices("ABéÀb÷ā", k=rng.randint(1, 9))) for _ in range(60))) for k in range(60)]
    rows += [(1, rows[1][1]), (2, None), (3, ""), (4, "Q" * 9000 + " " + "q" * 9000 + "1" + "Q" * 9000), (5, "À"), (6, "abcdefǵ abcdefg-abcdefg")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    assert {r.word: r.n for r in spelling.vocabulary(frame, damaged).collect()} == brute_words(rows, damaged)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got(spelling.op12_spelling(spark, sf_dir)) == brute(brute_words(docs, spelling.DAMAGED))


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert got(spelling.variants(spelling.vocabulary(none))) == []
    rows = spark.createDataFrame([(None, "abcde abcde abcde")] * 2, "doc_id long, text string")
    assert got(spelling.variants(spelling.vocabulary(rows, 1))) == [("abcde", None, "abcde", 6, 0, None)]
