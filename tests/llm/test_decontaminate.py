import hashlib
import random
import re

from quern.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width=10):
    words = split(text)
    hit, names = set(), set()
    for name, item in items:
        own = split(item)
        n = min(width, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                names.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(names)


def found(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in df.collect()}


def case(seed):
    rng = random.Random(seed)
    item = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, item(rng.choice([0, 1, 3, 5, 12, 15]) if seed % 2 else rng.choice([12, 15, 40]))) for k in range(6)] + [(None, None), (2, "x y z")]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice("abcde") for _ in range(rng.choice([0, 3, 60, 400])))) for k in range(30)]
    docs += [(100 + k, f"Zz {t} tail É9") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, "X, Y. Z!"), (202, "")]
    return items, docs


def test_against_brute_force(spark):
    for seed in range(4):
        items, docs = case(seed)
        left = spark.createDataFrame(docs, "doc_id long, text string")
        right = spark.createDataFrame(items, "item_id long, text string")
        expected = {d: brute(t, items, 5) for d, t in docs}
        assert found(decontaminate.find(left, right, 5)) == expected
        assert found(decontaminate.find(left, right, 5, block_words=20)) == expected


def test_pieces_blocks_and_parts(spark, monkeypatch):
    """Items cut into pieces, pieces dealt to blocks, stretches dealt to parts; repeated rows, a long text, clashing names."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 30)
    items, docs = case(2)
    docs = [(d, t, d) for d, t in docs + docs[:5] + [(300, "abc " * 700_000 + items[0][1])]]
    left = spark.createDataFrame(docs, "doc_id long, text string, _digest long")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(left, right, 5, block_words=20).collect()
    assert sorted((r.doc_id, r._digest, r.n_words, r.n_hit, r.item_ids) for r in got) == sorted((d, d, *brute(t, items, 5)) for d, t, _ in docs)


def test_documents(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = {}
    for d in docs:
        n, hit, names = brute(d.text, items)
        expected[d.doc_id] = (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.op9_decontaminate(spark, sf_dir).collect()}
    assert got == expected and any(x[-1] for x in got.values())


def test_removal_and_empty_tables(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    long = "plain words stay where they are " * 8
    docs = spark.createDataFrame([(1, f"{long}{passage.upper()}! {long}", 1), (2, passage, 2), (3, long, 3), (4, None, 4)], "doc_id long, text string, n_hit int")
    got = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, items).collect()}
    assert got == {1: f"{long}! {long}", 3: long, 4: None}
    assert decontaminate.find(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontaminate.find(docs, items.limit(0)).collect()} == {0}
