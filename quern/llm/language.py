"""Language identification by cross-parsing: the language whose text explains a document in phrases of fewest bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import layout, slices, table

#: The bounded training sample: about so many documents a language, each cut to so many bytes from a
#: random place, and so many bytes in all (split between the languages, MAX_BYTES each at most).
SAMPLE_DOCS = 48
SAMPLE_BYTES = 1_000
MAX_BYTES = 48_000
TOTAL_BYTES = 480_000
#: Documents are parsed side by side in strips of so many bytes.
STRIP = 2_048

#: Symbols: 0 leaves the parse as it is, 1 is any run of bytes that are no letters, 2 to 27 are a to z,
#: the rest stands for the bytes of other letters.
SYMBOLS = 64
_CODE = np.ones(256, dtype=np.uint8)
_CODE[97:123] = np.arange(2, 28)
_CODE[65:91] = np.arange(2, 28)
_CODE[128:] = 28 + np.arange(128) % 36

PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrases", T.LongType())])


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of lower-cased texts, where a run of bytes without letters is one symbol; offsets."""
    data, offsets = layout(pc.utf8_lower(texts.cast(pa.large_string())))
    codes = _CODE[data]
    if len(codes):
        again = np.zeros(len(codes), bool)
        again[1:] = (codes[1:] == 1) & (codes[:-1] == 1)
        inner = offsets[(offsets < len(codes))]
        again[inner] = False
        keep = ~again
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, offsets


def automaton(symbols: np.ndarray) -> np.ndarray:
    """The suffix automaton of a text as one dense table.

    Entry (state, symbol) holds the next state's row times two, plus one where the current phrase
    ends: the longest match cannot go on, and the symbol starts the next phrase from the root.
    """
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    # the last row is the state after a symbol that the text lacks: every symbol starts a new phrase there
    lost = len(steps)
    restart = np.full(SYMBOLS, lost, np.int64)
    for c, q in steps[0].items():
        restart[c] = q
    out = np.empty((lost + 1, SYMBOLS), np.int64)
    out[:] = restart * SYMBOLS * 2 + 1
    for state, edges in enumerate(steps):
        for c, q in edges.items():
            out[state, c] = q * SYMBOLS * 2
    out[:, 0] = np.arange(lost + 1) * SYMBOLS * 2
    return out.astype(np.int32)


def phrases(tables: list[np.ndarray], symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Phrases of each document's parse against each table: (documents, languages).

    Strips of all documents go through the automaton together, one symbol of each at a step; a
    strip starts a phrase of its own.
    """
    sizes = np.diff(offsets)
    strips = -(-sizes // STRIP)
    doc = np.repeat(np.arange(len(sizes)), strips)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(strips) - strips, strips)
    begin = offsets[:-1][doc] + nth * STRIP
    length = np.minimum(STRIP, offsets[1:][doc] - begin)
    order = np.argsort(-length, kind="stable")
    doc, begin, length = doc[order], begin[order], length[order]
    out = np.zeros((len(sizes), len(tables)), np.int64)
    if not len(doc):
        return out
    deep = int(length[0])
    live = np.searchsorted(-length, -np.arange(deep), "left")  # strips longer than the step
    padded = np.concatenate([symbols, np.zeros(1, np.uint8)])
    for k, dense in enumerate(tables):
        flat = dense.ravel()
        state = np.zeros(len(doc), np.int32)
        count = np.ones(len(doc), np.int64)
        for step in range(deep):
            m = live[step]
            got = flat[state[:m] + padded[begin[:m] + step]]
            count[:m] += got & 1
            state[:m] = got >> 1
        out[:, k] = np.bincount(doc, weights=count, minlength=len(sizes))
    return out


def is_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


def fit(labelled: DataFrame) -> dict[str, tuple[np.ndarray, int]]:
    """Automata of a bounded sample of labelled texts (columns text, lang) and their symbols of training, by language.

    Counts of different texts per language (HyperLogLog) give the share of them to sample, by a hash of
    the text, so copies of a text count once; the sampled pieces reach the driver, SAMPLE_DOCS times
    four of SAMPLE_BYTES at the most for each language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * SAMPLE_DOCS / n))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.lit(3), "text"), F.greatest(F.char_length("text") - SAMPLE_BYTES, F.lit(1))) + 1
    piece = F.substring(F.col("text"), place.cast("int"), F.lit(SAMPLE_BYTES))
    sampled = usable.where(chance < F.element_at(share, F.col("lang"))).select("lang", piece.alias("piece"), chance.alias("chance"))
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for row in sampled.distinct().orderBy("chance", "piece").limit(4 * SAMPLE_DOCS * len(counts)).collect():
        texts[row.lang].append(row.piece)
    room = min(MAX_BYTES, TOTAL_BYTES // len(counts))
    out = {}
    for lang in sorted(texts):
        symbols, _ = _symbols(pa.array([" ".join(texts[lang][:SAMPLE_DOCS])], pa.string()))
        symbols = symbols[:room]
        out[lang] = automaton(symbols), len(symbols)
    return out


def predict(docs: DataFrame, model: dict[str, tuple[np.ndarray, int]]) -> DataFrame:
    """docs (a column text) with lang_pred, score and phrases.

    Each whole text is parsed against each language's automaton into longest matches; the language
    of fewest bits wins, the first by name on ties.  A phrase takes the bits that name a place in the
    language's training text or a symbol, since more text makes longer phrases.  score is the
    runner-up's bits over the sum of both, from 0.5 (a tie) to 1, and 1 with one language only.  Null texts, texts without a
    letter and all texts of a model without languages give `und` with score 0 and no phrases.
    Repeated rows fare alike, very long texts are read whole in a slice of their own, an empty
    table stays empty, and columns of docs named as the three are replaced.
    """
    base = docs.drop(*PREDICTED.fieldNames())
    schema = T.StructType([*base.schema.fields, *PREDICTED.fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TOTAL_BYTES * 2 states of SYMBOLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables = list(shared.value), [x for x, _ in shared.value.values()]
        price = np.log2(np.array([n for _, n in shared.value.values()], float) + SYMBOLS)
        for batch in batches:
            for part in slices(batch, limit=8 << 20):
                texts = part.column("text").cast(pa.large_string())
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                names: list[str] = ["und"] * part.num_rows
                score, fewest = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                if langs and lettered.any():
                    counts = phrases(tables, *_symbols(texts))
                    bits = counts * price
                    best = bits.argmin(axis=1)
                    ranked = np.sort(bits, axis=1)
                    second = ranked[:, 1] if len(langs) > 1 else ranked[:, 0]
                    fewest = np.where(lettered, counts[np.arange(len(best)), best], 0)
                    sure = second / np.maximum(ranked[:, 0] + second, price.min()) if len(langs) > 1 else np.ones(len(best))
                    score = np.where(lettered, sure, 0.0)
                    names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                added = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(fewest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *PREDICTED.fieldNames()])

    return base.mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(is_training(F.col("doc_id"))).select("text", "lang"))
    held_out = ~is_training(F.col("doc_id"))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
