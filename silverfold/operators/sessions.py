"""Sessions out of events separated by inactivity gaps (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def sessionize(events: DataFrame, key: str, ts: str, gap: int, weight: str | None = None, day_split: bool = True) -> DataFrame:
    """Sessions of each key: ``key, start_at, end_at, duration, n_events``.

    Sweep line: each event adds one at its time and takes one off at time + gap; where
    the running sum falls to zero the session closes. An event exactly ``gap`` after the
    last one still belongs to the session (additions sort before subtractions).

    The line is swept per key and UTC day, over events pre-aggregated to distinct
    seconds, so a partition holds at most 2 * 86,400 rows however hot its key is. With
    ``day_split`` a new day starts a new session; without it, sessions reaching over
    midnight are joined afterwards from the first and last session of each day alone.

    ``ts`` is unix seconds. Rows with a null key or time are left out; repeated rows
    count as often as they occur (drop repeats before, or pass ``weight``). An empty
    input gives no rows. Other columns of ``events`` are ignored, whatever their names.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    seconds = (
        events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(key).alias("__k"), F.col(ts).cast("long").alias("__t"))
        .agg(n.cast("long").alias("__n"))
        .withColumn("__d", F.floor(F.col("__t") / DAY))
    )
    deltas = seconds.select(
        "__k", "__d", F.inline(F.array(F.struct(F.col("__t").alias("at"), F.col("__n").alias("delta")), F.struct((F.col("__t") + gap).alias("at"), (-F.col("__n")).alias("delta"))))
    )
    line = Window.partitionBy("__k", "__d").orderBy("at", F.col("delta").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = deltas.withColumn("open", F.sum("delta").over(line))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    swept = swept.withColumn("no", F.coalesce(F.sum((F.col("open") == 0).cast("int")).over(before), F.lit(0)))
    event_at = F.when(F.col("delta") > 0, F.col("at"))
    found = swept.groupBy("__k", "__d", "no").agg(
        F.min(event_at).alias("start_at"), F.max(event_at).alias("end_at"), F.sum(F.when(F.col("delta") > 0, F.col("delta"))).alias("n_events")
    )
    if not day_split:
        found = _join_days(found, gap)
    return found.select(F.col("__k").alias(key), "start_at", "end_at", (F.col("end_at") - F.col("start_at")).alias("duration"), "n_events")


def _join_days(found: DataFrame, gap: int) -> DataFrame:
    """Joins sessions over midnight. Only the first and last of a key's day can reach over it."""
    day = Window.partitionBy("__k", "__d")
    found = found.withColumn("edge", (F.col("no") == 0) | (F.col("no") == F.max("no").over(day)))
    edge = found.where("edge")
    # at most two rows a key and day meet here
    line = Window.partitionBy("__k").orderBy("start_at")
    edge = edge.withColumn("new", F.coalesce((F.col("start_at") - F.lag("end_at").over(line) > gap).cast("int"), F.lit(1)))
    edge = edge.withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.groupBy("__k", "run").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n_events").alias("n_events"))
    return found.where("not edge").select("__k", "start_at", "end_at", "n_events").unionByName(edge.select("__k", "start_at", "end_at", "n_events"))
