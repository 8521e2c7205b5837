import re

import pytest

from quern.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    None, "", " \n\t ", "one", "a b c d e f g", "x y z w a b c d " * 6, "no end\nno end\nIt is a line that ends with care.\n" * 5,
    "Ünï cödé wörds ärë hérè. " * 8, "#### $$$ %%% a", "Home | About | Contact\n" + "These are the words of a page about the river and its bank. " * 3
    + "and it is long enough to stay here for all the twenty words.\nAll rights reserved.",
    "tab\tseparated\x0bwords\x0chere\r\nnext line", "w" * 70_000 + " tail", "a a a a a a a a a a a a a a a a a a a a a a",
    "\x1f control   and nbsp stay inside words",
]


PLAIN = " ".join(f"word{k} by the bank." for k in range(20))


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(covered), failed,
    )


def rows(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()}


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    assert rows(quality.measured(docs)) == {k: brute(t) for k, t in enumerate(ODD)}


def test_counts_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    expected = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert rows(quality.op10_quality(spark, sf_dir)) == expected


def test_lines_are_removed_and_clean_text_is_left_alone(spark):
    docs = spark.createDataFrame(
        [(1, f"Home | About | Contact\n{PLAIN}\nAll rights reserved.", "a", 3), (2, PLAIN, "b", 4)], "doc_id long, text string, kept string, extra int"
    )
    got = {r.doc_id: r for r in quality.measured(docs).collect()}
    assert got[1].kept and "Home" not in got[1].cleaned and "rights" not in got[1].cleaned and PLAIN in got[1].cleaned
    assert got[2].cleaned is None and got[2].n_bad_lines == 0 and got[2].extra == 4


def test_empty_table(spark):
    assert quality.measured(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ODD)
def test_a_failed_base_is_never_kept(spark, text):
    found = quality._measure(__import__("pyarrow").array([text], "string"))
    assert not (found["base_failed"][0] and found["kept"][0])
