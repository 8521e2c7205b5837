"""Planted passages in layouts whose sentences and lines do not fit the units."""

import random

import pyarrow as pa
import pytest

from quern.llm import substrings

WORDS = [a + b for a in ("ka", "lo", "mir", "ten", "sul", "vo", "bra", "dei") for b in ("na", "rt", "so", "lim", "qua", "ed", "po", "xi")]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def verse(rng, words):
    return "\n" + "\n".join(" ".join(words[k : k + 4]) for k in range(0, len(words), 4)) + "\n"


def short_sentences(rng, words):
    return " " + " ".join(" ".join(words[k : k + 3]).capitalize() + "." for k in range(0, len(words), 3)) + " "


def inside_sentence(rng, words):
    return " ".join([*prose(rng, rng.randint(5, 9)), *words, *prose(rng, rng.randint(5, 9))])


@pytest.mark.parametrize("layout", [verse, short_sentences, inside_sentence])
def test_passage_in_layout(spark, layout):
    rng = random.Random(5)
    words = prose(rng, 80)
    docs = [(k, " ".join(prose(rng, 30 + k)) + layout(rng, words) + " ".join(prose(rng, 37 - k))) for k in range(3)]
    alone = [(9, " ".join(prose(rng, 300)) + layout(rng, prose(rng, 80)))]
    found = {r.doc_id: r for r in substrings.deduplicated(spark.createDataFrame(docs + alone, "doc_id long, text string")).collect()}
    planted = len(" ".join(words))
    assert found[0].n_removed == 0 and found[9].n_removed == 0
    assert all(0.65 * planted < found[k].n_removed < 1.4 * planted for k in (1, 2))


def test_text_without_spaces(spark):
    rng = random.Random(6)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(n))
    thai = lambda n: "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(n))
    for make in (han, thai):
        passage = make(40) + "。" + make(60)
        docs = [(k, make(30 + k) + passage + make(25 + k)) for k in range(3)]
        found = {r.doc_id: r for r in substrings.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert found[0].n_removed == 0
        for k in (1, 2):
            assert 0.7 * 101 * 3 < found[k].n_removed <= 101 * 3
            raw, kept, at = docs[k][1].encode(), b"", 0
            for s in found[k].removed:
                kept, at = kept + raw[at : s.lo], s.hi
            assert (kept + raw[at:]).decode() == found[k].text


def test_least_passage_is_found():
    """Any 51 words leave RUN_WORDS between cuts that their surroundings cannot move."""
    rng = random.Random(7)
    for _ in range(200):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(51)]
        a, b = (" ".join([*prose(rng, rng.randint(0, 40)), *words, *prose(rng, rng.randint(0, 40))]) for _ in range(2))
        doc, lo, hi, first, until, digest, two = substrings.units(pa.array([a, b]))
        doc, lo, hi, first, until, digest = (x[two == 0] for x in (doc, lo, hi, first, until, digest))
        known = set(digest[doc == 0].tolist())
        found = [x[1:5] for x in zip(doc.tolist(), lo.tolist(), hi.tolist(), first.tolist(), until.tolist(), digest.tolist()) if x[0] == 1 and x[5] in known]
        spans = substrings.spans_of([tuple(x) for x in found])
        assert len(spans) == 1 and len(b[spans[0][0] : spans[0][1]].split()) >= substrings.RUN_WORDS


def test_spans_run_over_lines_and_pieces():
    assert substrings.spans_of([(10, 20, 3, 6), (30, 40, 12, 15)]) == []
    assert substrings.spans_of([(10, 20, 3, 6), (0, 15, 0, 20), (12, 50, 12, 30)]) == [(0, 50)]
    assert substrings.spans_of([(0, 15, 0, 12), (15, 40, 12, 24), (41, 50, 24, 40)]) == [(0, 40)]
