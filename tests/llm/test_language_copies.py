"""Languages that are mostly copies of one text, or have far less training text than others."""

import random

from quern.llm import language


def talk(rng, chain, n):
    """Words from a chain of letters: two chains share their letters, not their order."""
    out, c = [], rng.choice("abcdefgh")
    for _ in range(n):
        out.append(c)
        c = rng.choice(chain[c])
    return "".join(out)


def chain(seed):
    rng = random.Random(seed)
    return {c: "".join(rng.choices("abcdefgh ", k=4)) + rng.choice("abcdefgh") for c in "abcdefgh "}


def right(spark, model, chains, rng, n=60):
    docs = [(lang, talk(rng, c, 200)) for lang, c in chains.items() for _ in range(n)]
    got = language.predict(spark.createDataFrame(docs, "lang string, text string"), model).collect()
    return {lang: sum(r.lang_pred == lang for r in got if r.lang == lang) / n for lang in chains}


def test_copies_count_once(spark):
    rng, chains = random.Random(1), {"aa": chain(1), "bb": chain(2)}
    one = talk(rng, chains["aa"], 500)
    rows = [("aa", one)] * 30_000 + [(lang, talk(rng, c, 500)) for lang, c in chains.items() for _ in range(150)]
    model = language.fit(spark.createDataFrame(rows, "lang string, text string").select("text", "lang"))
    assert all(n > 0.9 * 48 * 500 for _, n in model.values())
    assert min(right(spark, model, chains, rng).values()) > 0.95


def test_little_training_text(spark):
    """Two varieties, one a mixture close to the other: the one with little text still gets its own documents."""
    rng, base = random.Random(2), chain(3)
    near = base | {c: x[:3] + y[:2] for (c, x), y in zip(list(base.items())[:4], chain(4).values())}
    chains = {"big": base, "small": near}
    rows = [("big", talk(rng, base, 1000)) for _ in range(60)] + [("small", talk(rng, near, 1000))] * 3
    model = language.fit(spark.createDataFrame(rows, "lang string, text string").select("text", "lang"))
    assert model["small"][1] < 1_001 < 40_000 < model["big"][1]
    share = right(spark, model, chains, rng)
    assert min(share.values()) > 0.9, share
