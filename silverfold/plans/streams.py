"""Queries over streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from silverfold.plans.registry import query
from silverfold.session import shared_folder, table
from silverfold.streaming import watch

BURSTS = """WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 3600000000 THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, no"""


def _out(df):
    return df.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "n")


@query("s2_debounce", BURSTS)
def debounce(spark, d):
    """Bursts of a user's changes, closed by an hour's quiet, over the table."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _out(watch.debounce(e, ["user_id"], quiet="1 hour"))


@query("s2_debounce_stream", BURSTS)
def debounce_stream(spark, d):
    """The same over the table read as a stream, in append mode."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    src = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    got = watch.debounce(watch.with_end(src, "ts", at), ["user_id"], quiet="1 hour", late="1 day")
    return _out(watch.run_to_end(got, at).where("user_id is not null"))


@query("s2_sliding_rate", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events),
f AS (SELECT event_id, us, done, first_value(us) OVER w AS us0, first_value(done) OVER w AS d0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN us - us0 >= 2000000 THEN round((done - d0) / ((us - us0) / 1e6), 9) END AS rate FROM f""")
def rate(spark, d):
    """A user's events a second over the last day."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("done", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return watch.sliding_rate(e, ["user_id"], "ts", "done", span_s=86400).select("event_id", F.round("rate", 9).alias("rate"))
