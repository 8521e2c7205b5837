"""The streaming operators run over the events table as one finite stream, and their batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.retail import query
from quern.sources.stage import shared_dir
from quern.streaming import events


def drained(spark: SparkSession, sf_dir: str, build, mode: str = "append") -> DataFrame:
    """What a query over the stream of the events table has written once all of it is read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(spark)}/quern/stream-{uuid.uuid4().hex}"
    running = build(stream).writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("""WITH e AS (SELECT *, max(ts) OVER () AS last FROM events)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM e
GROUP BY 1, 2, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= any_value(last) - INTERVAL 1 DAY""")
def stream_windows(spark, sf_dir):
    """Closed hours only: a window is written once the watermark has passed its end."""
    got = drained(spark, sf_dir, events.windowed)
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("value", 4).alias("value"))


@query("""WITH d AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, round(sum(value), 4) AS value FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_sessions(spark, sf_dir):
    got = drained(spark, sf_dir, events.sessions)
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", F.round("value", 4).alias("value"))


@query("SELECT count(DISTINCT event_id) AS events FROM events")
def stream_first_seen(spark, sf_dir):
    return drained(spark, sf_dir, lambda s: events.first_seen(s).select("event_id")).agg(F.count("*").alias("events"))
