"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.llm.common import NOT_SPACE, layout, mix, shingle_hashes, slices, table, word_hashes, words

#: Characters counted as symbols, and those that may end a line of few words.
SYMBOLS = "#*$%&|<>"
ENDINGS = ".!?:;,\"')]}"
#: Phrases of boilerplate lines.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "lorem ipsum", "click here", "sign in", "sign up", "log in", "subscribe to", "read more",
)
#: Separators of navigation lines.
SEPARATORS = "|»›·"

#: A document of fewer words fails.
MIN_WORDS = 20
#: Percentage of words in repeated 8-word windows above which a document fails.
MAX_REPEATED = 30
WINDOW = 8
#: A line of fewer words must end in punctuation.
FRAGMENT_WORDS = 4
#: A line with more symbols per hundred characters of its words fails.
LINE_SYMBOLS = 20
#: Boilerplate and navigation lines have at most so many words; a longer line is navigation if so many words
#: have a separator among them.
SHORT_LINE, WORDS_PER_SEPARATOR = 20, 5
#: Percentage of the characters in words that a document may lose with its lines.
MAX_LOST = 50

STATS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("n_bad_lines", T.LongType()),
    T.StructField("lost_chars", T.LongType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("cleaned", T.StringType()),
])

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS.encode())] = 1
_ENDING = np.zeros(256, dtype=bool)
_ENDING[list(ENDINGS.encode())] = True
_ENDING[128:] = True
_IN_LINE = np.ones(256, dtype=bool)
_IN_LINE[10] = False
_SUSPECT = "|".join([f"[{re.escape(SEPARATORS)}]", *map(re.escape, BOILERPLATE)])
_PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_SEPARATED = re.compile(f"[{re.escape(SEPARATORS)}]")


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _later_copies(keys: np.ndarray) -> np.ndarray:
    """True where a key equals an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def _measure(texts: pa.Array) -> dict[str, list | np.ndarray]:
    data, offsets = layout(texts)
    n = len(offsets) - 1
    starts, ends, firsts = words(data, offsets, NOT_SPACE)
    n_words = np.diff(firsts)
    points = _running((data & 0xC0) != 0x80)
    symbols = _running(_SYMBOL[data])
    word_points = points[ends] - points[starts]
    word_chars = np.diff(_running(word_points)[firsts])

    # windows found twice inside a document; shorter documents have none
    hashes, index = shingle_hashes(word_hashes(data, starts, ends), firsts, WINDOW)
    doc = np.repeat(np.arange(n), np.diff(index))
    at = np.arange(len(hashes)) - index[:-1][doc] + firsts[:-1][doc]
    long = n_words[doc] >= WINDOW
    at, keys = at[long], mix(hashes[long] ^ mix(doc[long].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = np.diff(_running(np.cumsum(cover[:-1]) > 0)[firsts])

    # lines: runs without a line feed, which suffices as lines without a word count nowhere
    l_starts, l_ends, l_firsts = words(data, offsets, _IN_LINE)
    l_doc = np.repeat(np.arange(n), np.diff(l_firsts))
    lo, hi = np.searchsorted(starts, l_starts), np.searchsorted(starts, l_ends)
    l_words = hi - lo
    worded = l_words > 0
    line_keys = mix(word_hashes(data, l_starts, l_ends) ^ mix(l_doc.astype(np.uint64)))[worded]
    dup_lines = np.bincount(l_doc[worded][_later_copies(line_keys)], minlength=n)

    l_points = _running(word_points)
    l_chars = l_points[hi] - l_points[lo]
    l_symbols = symbols[l_ends] - symbols[l_starts]
    last = data[np.maximum(ends[np.maximum(hi - 1, 0)] - 1, 0)] if len(ends) else np.zeros(len(l_starts), np.uint8)
    bad = worded & ((l_words < FRAGMENT_WORDS) & ~_ENDING[last] | (100 * l_symbols > LINE_SYMBOLS * l_chars))
    suspect = pc.fill_null(pc.match_substring_regex(texts, _SUSPECT, ignore_case=True), False).to_numpy(zero_copy_only=False)
    raw = data.tobytes()
    for k in np.flatnonzero(suspect[l_doc] & worded & ~bad):
        line = raw[l_starts[k] : l_ends[k]].decode("utf-8", "replace")
        short, parts = l_words[k] <= SHORT_LINE, len(_SEPARATED.findall(line))
        bad[k] = (short and bool(_PHRASE.search(line))) or (parts >= 2 and (short or parts * WORDS_PER_SEPARATOR >= l_words[k]))
    lost = np.bincount(l_doc[bad], weights=l_chars[bad], minlength=n).astype(np.int64)
    n_bad = np.bincount(l_doc[bad], minlength=n)

    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
    kept = ~failed & (100 * lost <= MAX_LOST * word_chars)
    cleaned: list[str | None] = [None] * n
    for d in np.flatnonzero(kept & (n_bad > 0)):
        drop = {int(l_starts[k]) for k in range(l_firsts[d], l_firsts[d + 1]) if bad[k]}
        place, out = int(offsets[d]), []
        for line in raw[offsets[d] : offsets[d + 1]].split(b"\n"):
            if place not in drop:
                out.append(line)
            place += len(line) + 1
        cleaned[d] = b"\n".join(out).decode("utf-8", "replace")
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup_lines, "n_repeat_words": repeated, "n_bad_lines": n_bad, "lost_chars": lost,
        "base_failed": failed, "kept": kept, "cleaned": cleaned,
    }


def measured(docs: DataFrame) -> DataFrame:
    """docs (a column text) with the counts and verdicts of the quality rules, and `cleaned`.

    Counts are over the whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (see STATS).  A line fails that has few words and no closing punctuation, many symbols, a
    boilerplate phrase (short lines), or navigation separators (two in a short line, many in a long one); a document is kept if it passes the base
    rules and its failed lines hold at most half of its characters in words.  `cleaned` is the
    text without failed lines where a kept document has some, else null.

    A null or empty text counts zero everywhere and fails; repeated rows fare alike; very long texts
    are read whole, in a slice of their own; an empty table stays empty; columns of these names are
    replaced.
    """
    base = docs.drop(*STATS.fieldNames())
    schema = T.StructType([*base.schema.fields, *STATS.fields])
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = _measure(part.column("text").cast(pa.string()))
                columns = [pa.array(found[f.name], kinds[f.dataType.simpleString()]) for f in STATS.fields]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *STATS.fieldNames()])

    return base.mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "cleaned")


def _sql() -> str:
    phrases = "|".join(re.escape(x) for x in BOILERPLATE).replace("\\ ", " ")
    separators = f"[{SEPARATORS}]"
    endings = ENDINGS.replace("'", "''")
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w FROM docs),
windows AS (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS times
  FROM (SELECT doc_id, k, array_to_string(w[k : k + {WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS k FROM split WHERE len(w) >= {WINDOW}))),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + {WINDOW})) AS p FROM windows WHERE times > 1) GROUP BY 1),
lines AS (SELECT doc_id, l, regexp_extract_all(l, '{word}') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)),
worded AS (
  SELECT doc_id, l, len(w) AS n, length(array_to_string(w, '')) AS chars, w[len(w)] AS last, length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) AS symbols FROM lines WHERE len(w) > 0),
judged AS (
  SELECT *, (n < {FRAGMENT_WORDS} AND NOT (contains('{endings}', right(last, 1)) OR unicode(right(last, 1)) >= 128)) OR 100 * symbols > {LINE_SYMBOLS} * chars
         OR (n <= {SHORT_LINE} AND regexp_matches(l, '(?i){phrases}')) OR (parts >= 2 AND (n <= {SHORT_LINE} OR parts * {WORDS_PER_SEPARATOR} >= n)) AS bad
  FROM (SELECT *, len(regexp_extract_all(l, '{separators}')) AS parts FROM worded)),
by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS dups, count(*) FILTER (bad) AS n_bad, coalesce(sum(chars) FILTER (bad), 0) AS lost, sum(chars) AS chars FROM judged GROUP BY 1),
counted AS (
  SELECT s.doc_id, len(s.w) AS n_words, coalesce(b.chars, 0) AS word_chars, length(regexp_replace(s.t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(b.dups, 0) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, coalesce(b.n_bad, 0) AS n_bad_lines, coalesce(b.lost, 0) AS lost_chars
  FROM split s LEFT JOIN by_line b ON b.doc_id = s.doc_id LEFT JOIN repeated r ON r.doc_id = s.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_bad_lines::BIGINT AS n_bad_lines, lost_chars::BIGINT AS lost_chars, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost_chars <= {MAX_LOST} * word_chars AS kept
FROM counted
"""


OP10_SQL = _sql()
