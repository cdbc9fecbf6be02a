"""Names for events out of the folders there are, and events out of pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverfold.functions import names
from silverfold.operators.places import haversine
from silverfold.operators.sessions import sessionize

#: Scores of the kinds of suggestions, the distance that counts as near, and how often a word is frequent.
NEXT_DAY, SAME_DAY, NEAR, FREQUENT = 120, 100, 90, 10
NEAR_KM, WORD_COUNT, WORDS, RADIUS_KM = 3.0, 3, 8, 6371.0
#: Limits of an event's pause in minutes and of its least number of pictures.
GAP_MINUTES, LEAST = (30, 2880), (2, 5000)


def _cells(lat: Column, lon: Column, around: bool) -> Column:
    """Cells of more than ``NEAR_KM`` a side a place lies in, or all it may be near to: bands of latitude, cut by longitude as wide as the band asks."""
    high = NEAR_KM / 110.0
    band = F.floor(lat / high)
    steps = F.sequence(F.lit(-1), F.lit(1)) if around else F.array(F.lit(0))

    def of_band(b: Column) -> Column:
        # the narrowest circle of the band and its neighbours tells how many cells go round it
        far = F.least(F.greatest(F.abs(b - 1), F.abs(b + 2)) * high, F.lit(90.0))
        n = F.greatest(F.floor(360 * F.cos(F.radians(far)) / high), F.lit(1))
        at = F.floor((lon + 180) / 360 * n)
        return F.transform(steps, lambda s: F.struct(b.cast("long").alias("band"), F.pmod(at + s, n).cast("long").alias("cell")))

    return F.array_distinct(F.flatten(F.transform(steps, lambda s: of_band(band + s))))


def suggest(selections: DataFrame, folders: DataFrame, limit: int = 5) -> DataFrame:
    """Names for selections of pictures: ``sel, title, score``, the best ``limit`` of each.

    ``selections`` has ``sel, day`` (yyyy-MM-dd) and ``lat, lon`` or null; ``folders`` has ``folder_id, date, title, lat, lon`` of the folders
    in use. Suggested are the name of the day before, with its counter moved on; names of other years' same day; names used less than 3 km away, the
    nearer the better; and the most frequent words of dated folders. A title counts once with its best score; ties go by title.

    Days meet by equal keys and places by cells, so no selection is compared with all folders; what all share, eight words, is sent to each.
    """
    s, k = selections.where("sel is not null"), folders.where("title is not null and title <> ''")
    day = s.select("sel", "day", F.substring("day", 6, 5).alias("md"))
    again = day.join(k.select("date", "title", F.substring("date", 6, 5).alias("md")), "md").where("date <> day").select("sel", "title", F.lit(SAME_DAY).alias("score"))
    yesterday = day.select("sel", F.date_format(F.date_sub(F.expr("try_cast(day as date)"), 1), "yyyy-MM-dd").alias("date"))
    after = yesterday.join(k.select("date", "title"), "date").select("sel", names.next_day(F.col("title")).alias("title"), F.lit(NEXT_DAY).alias("score"))
    at = s.where("lat is not null and lon is not null").select("sel", "lat", "lon", F.explode(_cells(F.col("lat"), F.col("lon"), False)).alias("c"))
    near = k.where("lat is not null and lon is not null").select("title", F.col("lat").alias("la"), F.col("lon").alias("lo"), F.explode(_cells(F.col("lat"), F.col("lon"), True)).alias("c"))
    km = haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo"), RADIUS_KM)
    close = at.join(near, "c").withColumn("km", km).where(F.col("km") < NEAR_KM).select("sel", "title", (F.lit(NEAR) - (F.col("km") * 10).cast("int")).alias("score"))
    often = folders.where("date is not null").select(F.explode(names.words(F.col("title"))).alias("title")).groupBy("title").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= WORD_COUNT)
    often = often.orderBy(F.desc("n"), "title").limit(WORDS).select("title", F.lit(FREQUENT).alias("score"))
    every = s.where("day is not null").select("sel").distinct().crossJoin(F.broadcast(often))
    best = again.unionByName(after).unionByName(close).unionByName(every).where("title <> ''").groupBy("sel", "title").agg(F.max("score").alias("score"))
    line = Window.partitionBy("sel").orderBy(F.desc("score"), "title")
    return best.withColumn("r", F.row_number().over(line)).where(F.col("r") <= limit).drop("r")


def event_candidates(files: DataFrame, gap_minutes: int, least: int) -> DataFrame:
    """Events of ``library_id, taken_at, id``: ``library_id, cand_key, day, start_at, end_at, n``.

    A pause of more than ``gap_minutes`` (30 to 2880) or a new day ends one; those of ``least`` (2 to 5000) pictures and more count.
    The pictures of an event are those of its library between its ends, see :func:`event_items`, as events never overlap.
    """
    gap = min(max(gap_minutes, GAP_MINUTES[0]), GAP_MINUTES[1]) * 60
    n = min(max(least, LEAST[0]), LEAST[1])
    e = sessionize(files.groupBy("library_id", "taken_at").agg(F.count(F.lit(1)).alias("w")), "library_id", "taken_at", gap, weight="w").where(F.col("n_events") >= n)
    key = F.concat_ws(":", *(F.col(c).cast("string") for c in ("library_id", "start_at", "end_at")))
    return e.select("library_id", key.alias("cand_key"), F.date_format(F.timestamp_seconds("start_at"), "yyyy-MM-dd").alias("day"), "start_at", "end_at", F.col("n_events").alias("n"))


def event_items(files: DataFrame, events: DataFrame) -> DataFrame:
    """The pictures of events: ``cand_key, id, seq``, in order of time. They meet by library and day, as no event goes on into the next day."""
    f = files.withColumn("day", F.date_format(F.timestamp_seconds("taken_at"), "yyyy-MM-dd"))
    got = f.join(events.select("library_id", "day", "cand_key", "start_at", "end_at"), ["library_id", "day"]).where("taken_at between start_at and end_at")
    return got.select("cand_key", "id", F.row_number().over(Window.partitionBy("cand_key").orderBy("taken_at", "id")).alias("seq"))
