import hashlib
import random
from collections import Counter

from quern.llm import suffixes


def brute(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    counts = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if counts[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(r)) if gone[k] and not (k and gone[k - 1]))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def case(seed):
    rng = random.Random(seed)
    letters = "abé " if seed % 2 else "abcdefghijklmnopqrstuvwxyz ä"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (39, 40, 41, 70, 150, 400)]
    docs = [text(rng.choice([5, 100, 900])) + rng.choice(passages) + text(rng.choice([0, 7, 60])) + rng.choice(passages) for _ in range(60)]
    base = text(700)
    for _ in range(20):
        edited = list(base)
        for _ in range(6):
            edited[rng.randrange(len(edited))] = rng.choice(letters)
        docs.append("".join(edited))
    docs += ["a" * 500, "a" * 39, "ab" * 200, "a" * 41, "erouble " * 60, base, base, "", None, passages[2]]
    return list(enumerate(docs))


def test_against_brute_force(spark, monkeypatch):
    for seed in range(3):
        rows = case(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(suffixes.cut(docs, 40, 8)) == brute(rows, 40)
        assert got(suffixes.cut(docs, 40, 8, block=3)) == brute(rows, 40)


def test_suffix_ranks():
    import numpy as np

    rng = random.Random(5)
    for letters, n, length in (("ab", 300, 40), ("abc", 200, 13), ("a", 50, 8), ("abcdef", 400, 5)):
        raw = "".join(rng.choice(letters) for _ in range(n)).encode()
        rank = suffixes.suffix_ranks(np.frombuffer(raw, np.uint8), length)
        cut = [(raw + b"\0" * length)[k : k + length] for k in range(n)]
        for i in range(n - length):
            for j in range(0, n - length, 7):
                assert (rank[i] < rank[j]) == (cut[i] < cut[j]) and (rank[i] == rank[j]) == (cut[i] == cut[j])


def test_long_text_through_spark(spark):
    """One text longer than a piece, which repeats itself across the pieces' edge."""
    rng = random.Random(9)
    body = "".join(rng.choice("abcdefgh ") for _ in range(suffixes.PIECE + 3_000))
    text = body + body[suffixes.PIECE - 700 : suffixes.PIECE + 900]
    row = suffixes.cut(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("kept").first()
    assert row.n_removed == 2 * 1600 and [(r.lo, r.hi) for r in row.removed] == [(suffixes.PIECE - 700, suffixes.PIECE + 900), (len(body), len(body) + 1600)]


def test_pieces_of_long_texts():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    text = "".join(rng.choice("abc") for _ in range(500))
    whole = np.frombuffer((text + text).encode(), np.uint8)
    got = suffixes.parse(whole, np.array([0, len(whole)]), 40, 8)
    assert got["hi"][-1] == len(whole) - 40 and got["lo"][0] == 0 and (got["lo"][1:] == got["hi"][:-1] + 1).all()
    assert pa.array(got["p1"]).null_count == 0


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(suffixes.op8_suffixes(spark, sf_dir))
    assert found == brute(docs, 400) and any(x[2] for x in found)


def test_repeated_rows_clashing_names_and_empty_table(spark):
    text = "xyz " * 200
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (None, text[:420], "c"), (2, None, "d")], "doc_id long, text string, kept string")
    rows = suffixes.cut(docs)
    assert sorted((r.n_removed for r in rows.collect())) == [0, 420, 800, 800]
    assert suffixes.cut(docs.limit(0)).count() == 0
    clash = docs.selectExpr("doc_id", "text", "kept as _hash", "1 as _spans", "2 as hash", "3 as _h", "4 as _id", "5 as removed")
    got_rows = suffixes.cut(clash).collect()
    assert sorted(r.n_removed for r in got_rows) == [0, 420, 800, 800] and {r["_hash"] for r in got_rows} == {"a", "b", "c", "d"} and {r["_spans"] for r in got_rows} == {1}


def test_repeated_rows_give_their_phrases_once(spark, monkeypatch):
    """One text as 500 equal rows, and a variant of it: the dictionary holds what two rows would give."""
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh ", k=600))
    variant = base[:300] + "#" + base[301:]
    seen, order = [], suffixes._dictionary_order
    monkeypatch.setattr(suffixes, "_dictionary_order", lambda phrases, *a: seen.append((phrases.count(), phrases.select("p1", "p2").distinct().count())) or order(phrases, *a))
    for rows in ([(1, base), (2, variant)], [(1, base)] * 500 + [(2, variant)]):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert got(suffixes.cut(frame, 40, 8)) == brute(rows, 40)
    assert seen[0][0] == seen[0][1] and seen[1][0] == seen[1][1] and seen[1][0] <= seen[0][0]
