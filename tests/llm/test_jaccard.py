import random
import re

from quern.llm import jaccard
from quern.llm.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    holders = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, (_, s) in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                root[find(k)] = find(j)
    least = {}
    for k, (d, _) in enumerate(sets):
        least[find(k)] = min(d, least.get(find(k), d))
    return sorted((d, len(s), least[find(k)]) for k, (d, s) in enumerate(sets))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_of_near_copies(spark):
    rng = random.Random(5)
    docs = []
    for size, edits in ((60, 3), (40, 1), (90, 2), (300, 7)):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        docs += [near(rng, base, rng.randint(0, edits)) for _ in range(60)]
    common = "one line that very many of all these documents share with each other in full"
    docs += [f"{common} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([4, 8, 60]))) for _ in range(150)]
    docs += ["", "a", "A", "a b", "a b c d e", "A  b\nc d E", " \t", None, None]
    rows = list(enumerate(docs))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as hash", "2 as _hash", "3 as tile", "4 as component_id")
    expected = brute(rows)
    assert got(jaccard.linked(frame)) == expected
    assert got(jaccard.linked(frame, block=3)) == expected  # many blocks to a tile
    assert got(jaccard.linked(frame, block=7, dealt=20)) == expected  # and tiles that come in parts


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(jaccard.op5_jaccard(spark, sf_dir)) == brute(docs)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(3, text, 1), (3, text, 1), (None, text, 2), (9, text + " more", 2), (4, None, 1)], "doc_id long, text string, n long")
    rows = [(r.doc_id, r.component_id) for r in jaccard.linked(docs).collect()]
    assert sorted(rows, key=str) == sorted([(3, 3), (3, 3), (None, 3), (9, 3), (4, 4)], key=str)
    assert sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [3, 4]
    assert jaccard.linked(docs.limit(0)).count() == 0


def test_blocks_hold_neighbouring_sizes():
    import numpy as np

    sizes = np.sort(np.random.default_rng(2).integers(1, 500, 300))
    nodes = np.arange(300)
    blocks = jaccard._blocks(nodes, sizes, 0, 20)
    assert sorted(np.concatenate([b for _, b in blocks]).tolist()) == list(range(300)) and max(len(b) for _, b in blocks) <= 20
    band = {int(x): number >> 40 for number, b in blocks for x in b}
    for i in range(300):
        for j in range(300):
            if jaccard.fits(sizes[i], sizes[j]):
                assert abs(band[i] - band[j]) <= 1


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[100 + k] == 100 for k in range(50))
    assert all(found[a] == found[b] for a, b in links if a != b)


def test_few_links_take_no_rounds(spark, monkeypatch):
    from quern.llm import graph

    rng, made = random.Random(3), []
    write = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, what: made.append(what) or write(df, what))
    order = rng.sample(range(1000), 1000)  # a path through shuffled numbers: many rounds for stars
    links = [*zip(order, order[1:]), *((2000, k) for k in range(1500, 1600)), (5000, 5000)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    expected = {k: 0 for k in range(1000)} | {k: 1500 for k in [*range(1500, 1600), 2000]}
    found = [(r.node, r.component) for r in graph.components(frame).collect()]
    assert len(made) <= 2 and len(found) == len(expected) and dict(found) == expected
    found = [(r.node, r.component) for r in graph.components(frame, held=50).collect()]  # more than a task holds
    assert len(found) == len(expected) and dict(found) == expected
    assert graph.components(frame.limit(0)).count() == 0
