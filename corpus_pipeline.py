"""A training corpus from `documents` in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, jaccard, mixing, quality, sharding
from quern.llm.common import stored, table, word_count


def _rewritten(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`; a column n_chars follows the text."""
    counted = docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in like.columns else docs
    return counted.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failed lines.

    A null or empty text fails; repeated rows fare alike and all stay; texts are judged whole; an
    empty table stays empty; other columns stay as they are, whatever their names.
    """
    kept = quality.measured(docs).where("kept")
    return _rewritten(kept.withColumn("text", F.coalesce("cleaned", "text")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (null last), then of the smallest hash of its text.

    Null and empty texts are no copies of each other and stay, as do rows of one doc_id with
    different texts; of rows equal in doc_id and text one stays; an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that are mostly such passages go.

    Null texts and items match nothing; equal items count once; repeated rows fare alike; an empty
    table of documents or items leaves what it is given; other columns stay as they are.
    """
    return _rewritten(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them, twice at most.

    Null texts have size 0; a null source is one of its own; ties in the order are broken by the
    rows' contents, and rows equal in all columns are interchangeable; an empty table stays empty.
    """
    return mixing.mix(docs, word_count(F.col("text")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot in a global shuffle.

    Rows go by doc_id, null first, then by a key of all columns; equal rows get a slot each; an
    empty table stays empty; columns named row_number, shard or slot are replaced.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("source mix", source_mix),
    ("sharding", shards),
]

#: SQL does not express the near-duplicate components; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
