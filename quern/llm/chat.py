"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import table

#: The template's control strings, and the two escapes that keep them out of texts.
OPEN, SPLIT, CLOSE = "<turn>", "<says>", "</turn>"
ESCAPES = (("\\", "\\b"), ("<", "\\l"))
TARGET = "assistant"


def escaped(text: Column) -> Column:
    """No control string can occur in the result: each starts with <, which becomes backslash-l."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """Expand conversations (conv_id, turn, role, text) into conv_id, example, text, loss_start, loss_end.

    Every assistant turn gives an example: all turns before it as context, then the turn itself,
    of which only the reply (code points loss_start to loss_end of text, end not included) is
    trainable.  Turns after the last reply give one more example with nothing trainable, so that
    a conversation can be read back from its last example.

    Turns go by turn, null first, then role and text.  Null role and text count as empty.  A null
    conv_id is a conversation of its own; repeated rows are repeated turns.  Texts are kept whole,
    whatever their length; an empty table gives no examples; other columns are not read.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SPLIT))
    said = turns.select(
        "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select("conv_id", F.struct(
        "turn", "role", "text",
        F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("shown"),
        F.char_length(head).alias("head"),
    ).alias("said"))
    talks = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    whole = talks.select("conv_id", F.col("said.role").alias("roles"), F.col("said.head").alias("heads"), F.col("said.shown").alias("shown"))
    places = F.filter(F.sequence(F.lit(1), F.size("roles")), lambda k: (F.element_at("roles", k) == TARGET) | (k == F.size("roles")))
    each = whole.select("conv_id", "roles", "heads", "shown", F.posexplode(places).alias("example", "last"))
    before = F.array_join(F.slice("shown", 1, F.col("last") - 1), "")
    target = F.element_at("shown", F.col("last"))
    trained = F.element_at("roles", F.col("last")) == TARGET
    start = F.char_length("before") + F.element_at("heads", F.col("last"))
    return each.withColumn("before", before).select(
        "conv_id", "example", F.concat("before", target).alias("text"),
        F.when(trained, start).otherwise(0).cast("long").alias("loss_start"),
        F.when(trained, F.char_length("before") + F.char_length(target) - len(CLOSE)).otherwise(0).cast("long").alias("loss_end"),
        (F.col("last") == F.size("roles")).alias("whole"),
    )


def turns_of(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    pieces = F.filter(F.split(text, OPEN), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(
        unescaped(F.substring_index(x, SPLIT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(x, SPLIT, -1), CLOSE, 1)).alias("text"),
    ))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted examples alone."""
    read = formatted.select(
        "conv_id", "example", F.char_length("text").cast("long").alias("chars"),
        unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"),
        F.when(F.col("whole"), turns_of(F.col("text"))).alias("turns"),
    ).select(
        "conv_id", "example", "chars", "loss", F.size("turns").cast("long").alias("n_turns"),
        F.when(F.col("turns").isNotNull(), F.sha2(F.encode(F.array_join(F.transform(
            "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256)).alias("turns_sha256"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        joined.alias("loss"), F.sum("chars").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: A conversation that is all control strings.
PROBE = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, TARGET, PROBE)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(examples(talks))


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         length(replace(replace(role, '\', '\b'), '<', '\l'))
         + length(replace(replace(text, '\', '\b'), '<', '\l')) + 19 AS shown
  FROM said),
summed AS (
  SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY place) AS through FROM placed)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR place = n THEN through ELSE 0 END)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
