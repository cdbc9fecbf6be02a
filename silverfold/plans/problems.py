"""The queries of the general problems (p1, p3, p4, p6) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverfold.operators.diff import diff_copies, nfc
from silverfold.operators.hierarchy import hierarchy
from silverfold.operators.nearby import nearby
from silverfold.operators.sessions import sessionize
from silverfold.plans import problem_sql as sql
from silverfold.plans.registry import query
from silverfold.session import table

OUTING_GAP_S = 1800
#: Usable times, fixed values.
USABLE_FROM, USABLE_TO = 946684800, 1798761599


def usable(col) -> F.Column:
    return col.between(USABLE_FROM, USABLE_TO)


@query("p3_found", sql.P3)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "folders")).withColumnRenamed("id", "folder_id")


@query("p3_intervals")
def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each folder's place in preorder; the folders below are the range (pre, last]."""
    return hierarchy(table(spark, d, "folders"), intervals=True, paths=False).select(F.col("id").alias("folder_id"), "root_id", "n_desc", "pre", "last")


@query("p4_found", sql.P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").where("trashed_at is null").where(usable(F.col("taken_at"))).select("id", "folder_id", "taken_at")
    # repeats go first; then one row a folder and second, so a hot folder is small at the join
    seconds = files.distinct().groupBy("folder_id", "taken_at").agg(F.count(F.lit(1)).alias("n"))
    folders = table(spark, d, "folders").where("library_id is not null").select(F.col("id").alias("folder_id"), "library_id").distinct()
    events = seconds.join(folders, "folder_id")
    return sessionize(events, "library_id", "taken_at", OUTING_GAP_S, weight="n").select("library_id", "start_at", "end_at", F.col("n_events").alias("n_files"))


@query("p6_found", sql.P6)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "tree_files")
    path = F.when(F.coalesce(F.col("sub"), F.lit("")) == "", F.col("name")).otherwise(F.concat("sub", F.lit("/"), "name"))
    rows = rows.select("side", "pair_id", nfc(path).alias("path"), "size", "full_hash", "modified_at", "rating")
    return diff_copies(rows.where("side = 'a'"), rows.where("side = 'b'"), ["pair_id", "path"], ["size", "full_hash", "modified_at", "rating"])


@query("p1_found", sql.P1)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "map_cells").where("not (lat = 0 and lon = 0)").select(F.col("cell_id").alias("id"), "lat", "lon")
    cities = table(spark, d, "geo_cities").select(F.col("city_id").alias("id"), "lat", "lon", F.col("cc").alias("code"), F.col("population").alias("pop"))
    regions = table(spark, d, "geo_regions").select(F.col("region_id").alias("id"), "code", "level", "bbox", "polys")
    return nearby(cells, regions, cities).select("rel", "a_id", "b_id")
