"""Change feeds: keys that have been quiet for a while, and sliding rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interesting(path: Column, skip: list[str]) -> Column:
    """Whether a change may matter: no hidden file and no folder that is never scanned."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(skip))


def debounce(changes: DataFrame, keys: list[str], ts: str = "ts", quiet: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of changes of a key, closed once it has been quiet: ``keys, first_at, last_at, n``.

    Works on a stream and on a table alike. A change exactly ``quiet`` after the last one is
    part of the burst. The watermark is our own choice: changes later than ``late`` are
    dropped on a stream in append mode.
    """
    src = changes.withWatermark(ts, late) if changes.isStreaming else changes
    return src.groupBy(*keys, F.session_window(ts, quiet).alias("w")).agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n")).drop("w")


def sliding_rate(samples: DataFrame, keys: list[str], ts: str, done: str, span_s: int = 30, least_s: int = 2) -> DataFrame:
    """Progress a second over the last ``span_s`` seconds, null until ``least_s`` are covered: adds ``rate``."""
    w = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-span_s * 1_000_000, 0)
    s = samples.withColumn("__us", F.unix_micros(ts)).withColumn("__f", F.min(F.struct("__us", F.col(done).alias("d"))).over(w))
    took = (F.col("__us") - F.col("__f.__us")) / 1e6
    return s.withColumn("rate", F.when(took >= least_s, (F.col(done) - F.col("__f.d")) / took)).drop("__us", "__f")


def with_end(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """A stream over a table that ends: after its rows a tick of the far future, with null in all other columns, lets the watermark pass them all."""
    spark = stream.sparkSession
    tick = spark.range(1).select(*(F.lit("2200-01-01").cast("timestamp").alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema))
    tick.write.parquet(f"{folder}/tick")
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{folder}/tick"))


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all there is, adding what is closed to a table of the folder, and reads that.

    In append mode a burst leaves the state once the watermark has passed it, so the state holds open
    bursts alone and nothing is written twice; what is still open at the end of a stream stays in the state.
    """
    spark = stream.sparkSession
    q = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").format("parquet").start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
