import re

from quern.llm import substrings

PASSAGE = "The river was high that spring and no boat could land. Émile waited. He counted the days, one after the other, in chalk. Nobody came."
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(raw):
    return [(m.start(), m.end(), m.group()) for m in WORD.finditer(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))]


def lines_of(text):
    """(lo, hi, words) of each line with a word: from its first word (the text's start for the first) to the next one's."""
    raw, out = text.encode(), []
    for lo, hi, word in words_of(raw):
        if out and b"\n" not in raw[out[-1][1] : lo]:
            out[-1] = (out[-1][0], hi, (*out[-1][2], word))
        else:
            out.append((lo, hi, (word,)))
    starts = [0] + [x[0] for x in out[1:]]
    return [(lo, hi, x[2]) for lo, hi, x in zip(starts, [*starts[1:], len(raw)], out)]


def got(df):
    return {r.doc_id: (r.text, [(s.lo, s.hi) for s in r.removed]) for r in df.collect()}


def held_against_rules(docs, found, least=substrings.RUN_WORDS, window=2 * substrings.WINDOW + substrings.RUN_WORDS):
    """By a plain reading: long lines seen before go, passages of `window` words seen before lose `least`, and what goes was seen before."""
    lines, passages, pairs = set(), set(), set()
    for doc_id, text in sorted(docs, key=lambda x: x[0]):
        kept, spans = found[doc_id]
        raw = (text or "").encode()
        assert spans == sorted(spans) and all(a < b for a, b in spans)
        rest, place = b"", 0
        for lo, hi in spans:
            rest, place = rest + raw[place:lo], hi
        assert kept == (None if text is None else (rest + raw[place:]).decode())
        inside = lambda lo, hi: any(a <= lo and hi <= b for a, b in spans)
        own = lines_of(text or "")
        seen = set()
        for lo, hi, words in own:
            if len(words) >= least:
                assert inside(lo, hi) == (words in lines or words in seen) or inside(lo, hi)
                seen.add(words)
        lines |= seen
        at = words_of(raw)
        flags = [inside(lo, hi) for lo, hi, _ in at]
        bare = [w for _, _, w in at]
        for k in range(len(bare) - window + 1):
            if tuple(bare[k : k + window]) in passages:
                assert sum(flags[k : k + window]) >= least
        passages |= {tuple(bare[k : k + window]) for k in range(len(bare) - window + 1)}
        now = set(zip(bare, bare[1:]))
        for a, b in spans:
            cut = [w for lo, hi, w in at if a <= lo and hi <= b]
            assert len(cut) >= least and sum(p in pairs or p in now for p in zip(cut, cut[1:])) == len(cut) - 1
        pairs |= now


ODD = [
    (1, f"Here is how it starts today.\n{PASSAGE}\nAnd so on it goes, for ever and ever."),
    (2, f"no stop before\n{PASSAGE}\nSomething else comes after it in this one here."),
    (3, PASSAGE), (4, None), (5, ""), (6, "Er. Er. Er."), (7, "Er. Er. Er."), (8, "x " * 300), (9, "x " * 300),
    (10, "same line of words in here twice\nsame line of words in here twice\n"), (11, "…?! \n .. "), (12, PASSAGE.upper().replace(",", " -")),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(d, t, 5) for d, t in ODD], "doc_id long, text string, n_bytes int")
    found = got(substrings.deduplicated(docs))
    held_against_rules(ODD, found)
    assert found[1][1] == [] and found[2][1] == [(15, 15 + len(PASSAGE.encode()) + 1)]
    assert found[3][0] == "" and found[12][0] == "" and found[9][0] == ""
    assert not found[10][1] and not found[7][1]  # short lines that repeat on their own stay


def test_short_lines_side_by_side(spark):
    lines = [f"row {k} of the table holds {k * k}" for k in range(8)]
    docs = [(1, "\n".join(lines)), (2, "first words here\n" + "\n".join(lines[:5]) + "\nlast words"), (3, "\n".join(f"{x}\nbetween {k}{k}" for k, x in enumerate(lines)))]
    found = got(substrings.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")))
    assert found[2][0] == "first words here\nlast words" and not found[3][1]


def test_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(substrings.op1_substrings(spark, sf_dir))
    held_against_rules(docs, found)
    assert any(spans for _, spans in found.values())


def test_hot_digest_is_dealt(spark):
    """One line in every document: its digest is hot and met in parts."""
    other = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    docs = [(k, f"{other(k)}\n{PASSAGE}\n{other(-k)}") for k in range(1, 301)]
    found = got(substrings.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")))
    held_against_rules(docs, found)
    assert not found[1][1] and all("Nobody came" not in found[k][0] for k in range(2, 301))


def test_very_long_text(spark):
    body = "\n".join(" ".join(f"w{(k * 7919 + j) % 99991}" for j in range(40)) for k in range(9_000))
    docs = [(1, body), (2, body + "\nand one line that is new in this document"), (3, "a" * 3_000_000)]
    found = got(substrings.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")))
    assert len(docs[0][1]) > 2 << 20 and not found[3][1] and found[2][0] == "and one line that is new in this document"


def test_repeated_rows_nulls_clashing_names_and_empty_table(spark):
    docs = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (1, PASSAGE)], "doc_id long, text string").selectExpr("*", "7 as hash", "8 as _hash", "9 as spans", "10 as part")
    rows = substrings.deduplicated(docs).collect()
    kept = sorted((r.doc_id or 0, len(r.text)) for r in rows)
    assert kept[0] == (0, len(PASSAGE)) and kept[1][1] == kept[2][1] == 0
    assert {(r["hash"], r["_hash"], r["part"]) for r in rows} == {(7, 8, 10)}
    assert substrings.deduplicated(docs.limit(0)).count() == 0
