"""Read queries of the catalogue: pages, facets, timeline, map, libraries, trash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from silverfold.operators import catalog as c
from silverfold.plans.problems import usable
from silverfold.plans.registry import query
from silverfold.session import table

#: The catalogue in SQL: repeats dropped, unusable times null.
BASE = """
WITH f AS (
  SELECT DISTINCT * REPLACE (CASE WHEN taken_at BETWEEN 946684800 AND 1798761599 THEN taken_at END AS taken_at) FROM files
), fo AS (SELECT DISTINCT * FROM folders), live AS (SELECT * FROM f WHERE trashed_at IS NULL)
"""
GPS = "(gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180 AND NOT (gps_lat = 0 AND gps_lon = 0))"


def files(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Files with the columns named; repeats go after the columns are cut, so only those are compared."""
    t = table(spark, d, "files")
    want = list(dict.fromkeys(["id", "trashed_at", *cols]))
    return t.select(*(F.when(usable(F.col("taken_at")), F.col("taken_at")).alias("taken_at") if x == "taken_at" else F.col(x) for x in want)).distinct()


def folders(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "folders").select("id", *cols).distinct()


def cat(spark: SparkSession, d: str, *cols: str) -> c.Catalog:
    return c.Catalog(files(spark, d, *cols), folders(spark, d, "library_id", "area", "rel_path", "volume_uuid"))


SHOWN = ("folder_id", "name", "ext", "size", "kind", "taken_at", "rating", "culling_flag", "favorite")


def _page(sort: str, descending: bool, **more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        extra = {"created": ["created_at"], "modified": ["modified_at"], "pixels": ["width", "height"], "duration": ["duration_ms"]}.get(sort, [])
        k = cat(spark, d, *SHOWN, *extra)
        return c.page(k, c.Filter(sort=sort, descending=descending, **more), 200).select("id", "folder_id", "name", "size", "kind", "taken_at", "sort_key")

    return run


for _sort, _expr in c.SORTS.items():
    _null = "''" if _sort == "name" else "0"
    for _desc in (True, False):
        _way = "DESC" if _desc else "ASC"
        _name = "q01_page" if (_sort, _desc) == ("taken", True) else f"q03_page_{_sort}_{_way.lower()}"
        query(_name, f"{BASE} SELECT id, folder_id, name, size, kind, taken_at, coalesce({_expr}, {_null}) AS sort_key FROM live ORDER BY sort_key {_way}, id {_way} LIMIT 201")(_page(_sort, _desc))


@query("q01_page_next", f"""{BASE}, k AS (SELECT coalesce(taken_at, 0) AS sort_key, id FROM live)
SELECT id, sort_key FROM k WHERE sort_key < 1500000000 OR (sort_key = 1500000000 AND id < 1000) ORDER BY sort_key DESC, id DESC LIMIT 51""")
def page_next(spark, d):
    """The page after a cursor."""
    return c.page(cat(spark, d, "taken_at", "name"), c.Filter(), 50, cursor=(1500000000, 1000)).select("id", "sort_key")


@query("q04_page_headers", f"""{BASE} SELECT id, strftime(make_timestamp(taken_at * 1000000), '%Y-%m') AS month, lower(ext) AS filetype,
  CASE culling_flag WHEN 1 THEN 'keep' WHEN 2 THEN 'drop' ELSE 'open' END AS culling, CAST(rating AS VARCHAR) AS stars, coalesce(cam_model, '') AS camera
FROM live ORDER BY coalesce(taken_at, 0) DESC, id DESC LIMIT 101""")
def page_headers(spark, d):
    k = cat(spark, d, "taken_at", "ext", "culling_flag", "rating", "cam_model")
    heads = {"month": "month", "filetype": "filetype", "culling": "culling", "stars": "rating", "camera": "camera"}
    return c.page(k, c.Filter(), 100).select("id", *(c.group_value(g).alias(n) for n, g in heads.items()))


@query("q05_summary", f"{BASE} SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM live")
def summary(spark, d):
    return c.summary(cat(spark, d, "size"), c.Filter())


@query("q06_timeline", f"""{BASE} SELECT CAST(strftime(make_timestamp(taken_at * 1000000), '%Y') AS INT) AS year, CAST(strftime(make_timestamp(taken_at * 1000000), '%m') AS INT) AS month,
  count(*) AS n, max(taken_at) AS newest FROM live WHERE taken_at IS NOT NULL GROUP BY 1, 2""")
def timeline(spark, d):
    return c.timeline(cat(spark, d, "taken_at"), c.Filter())


@query("q07_cursor_at", f"{BASE} SELECT coalesce(taken_at, 0) AS sort_key, id FROM live ORDER BY 1 DESC, 2 DESC LIMIT 1 OFFSET 499")
def cursor_at(spark, d):
    return c.cursor_at(cat(spark, d, "taken_at"), c.Filter(), 500)


@query("q08_by_ids", f"{BASE}, w(pos, id) AS (VALUES (0, 17), (1, 5), (2, 99999999), (3, 400)) SELECT w.pos, f.id, f.name, f.size FROM w JOIN f USING (id)")
def by_ids(spark, d):
    return c.by_ids(cat(spark, d, "name", "size"), [17, 5, 99999999, 400]).select("pos", "id", "name", "size")


@query("q09_detail", f"{BASE} SELECT f.id, f.name, f.size, f.width, f.height, fo.name AS folder, fo.rel_path FROM f JOIN fo ON fo.id = f.folder_id WHERE f.id = 17")
def detail(spark, d):
    fo = folders(spark, d, "name", "rel_path").select(F.col("id").alias("folder_id"), F.col("name").alias("folder"), "rel_path")
    return files(spark, d, "name", "size", "width", "height", "folder_id").where("id = 17").join(fo, "folder_id").select("id", "name", "size", "width", "height", "folder", "rel_path")


_T = "make_timestamp(taken_at * 1000000)"
_CELL = "printf('%.1f,%.1f', (floor(round(gps_lat * 10, 8) + 900) - 900) / 10 + 0.0, (floor(round(gps_lon * 10, 8) + 1800) - 1800) / 10 + 0.0)"
for _kind, _cols, _value, _order in (
    ("year", ["taken_at"], f"strftime({_T}, '%Y')", "value DESC"),
    ("day", ["taken_at"], f"strftime({_T}, '%Y-%m-%d')", "value DESC"),
    ("camera", ["cam_model"], "coalesce(cam_model, '')", "n DESC, value"),
    ("rating", ["rating"], "CAST(rating AS VARCHAR)", "value DESC"),
    ("kind", ["kind"], "CAST(kind AS VARCHAR)", "n DESC, value"),
    ("place", ["gps_lat", "gps_lon"], f"CASE WHEN {GPS} THEN {_CELL} ELSE '' END", "n DESC, value"),
):
    query(f"q10_facet_{_kind}", f"{BASE}, v AS (SELECT {_value} AS value FROM live) SELECT value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY value ORDER BY {_order} LIMIT 200")(
        lambda spark, d, kind=_kind, cols=_cols: c.facet(cat(spark, d, *cols), c.Filter(), kind)
    )


@query("q12_map_overview", f"{BASE} SELECT count(*) AS n, min(gps_lat) AS south, min(gps_lon) AS west, max(gps_lat) AS north, max(gps_lon) AS east FROM live WHERE {GPS}")
def map_overview(spark, d):
    return c.map_overview(cat(spark, d, "gps_lat", "gps_lon"), c.Filter())


@query("q13_map_cells", f"""{BASE}, k AS (SELECT CAST(floor(gps_lat + 90) AS BIGINT) AS ky, CAST(floor(gps_lon + 180) AS BIGINT) AS kx, gps_lat, gps_lon, id, cam_model AS label FROM live WHERE {GPS}),
m AS (SELECT ky, kx, label, row_number() OVER (PARTITION BY ky, kx ORDER BY count(*) DESC, label) AS r FROM k WHERE label IS NOT NULL GROUP BY ky, kx, label)
SELECT k.ky, k.kx, count(*) AS n, round(avg(gps_lat), 9) AS lat, round(avg(gps_lon), 9) AS lon, max(id) AS newest_id, count(DISTINCT k.label) AS labels, any_value(m.label) AS label
FROM k LEFT JOIN m ON m.ky = k.ky AND m.kx = k.kx AND m.r = 1 GROUP BY k.ky, k.kx ORDER BY n DESC, ky, kx LIMIT 4000""")
def map_cells(spark, d):
    got = c.map_cells(cat(spark, d, "gps_lat", "gps_lon", "cam_model"), c.Filter(), 1.0, label="cam_model")
    return got.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


@query("q14_map_covers", f"""{BASE}, k AS (SELECT CAST(floor(gps_lat + 90) AS BIGINT) AS ky, CAST(floor(gps_lon + 180) AS BIGINT) AS kx, max(id) AS id FROM live WHERE {GPS} GROUP BY 1, 2)
SELECT ky, kx, k.id AS newest_id, f.name AS cover FROM k JOIN f USING (id)""")
def map_covers(spark, d):
    got = files(spark, d, "gps_lat", "gps_lon", "name").where("trashed_at is null").where(c.valid_gps())
    cell = got.groupBy(F.floor(F.col("gps_lat") + 90).alias("ky"), F.floor(F.col("gps_lon") + 180).alias("kx")).agg(F.max(F.struct("id", "name")).alias("m"))
    return cell.select("ky", "kx", F.col("m.id").alias("newest_id"), F.col("m.name").alias("cover"))


@query("q15_libraries", f"""{BASE} SELECT l.id AS library_id, l.name, count(v.id) AS n, CAST(coalesce(sum(v.size), 0) AS BIGINT) AS bytes
FROM libraries l LEFT JOIN (SELECT live.id, live.size, fo.library_id FROM live JOIN fo ON fo.id = live.folder_id) v ON v.library_id = l.id GROUP BY l.id, l.name""")
def libraries(spark, d):
    # files are first counted by folder, so the join meets a row a folder
    per = files(spark, d, "folder_id", "size").where("trashed_at is null").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    lib = per.join(folders(spark, d, "library_id").select(F.col("id").alias("folder_id"), "library_id"), "folder_id").groupBy("library_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return table(spark, d, "libraries").select(F.col("id").alias("library_id"), "name").join(lib, "library_id", "left").select("library_id", "name", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n", "bytes")))


@query("q18_library_leaves", f"""{BASE}, n AS (SELECT folder_id, count(*) AS n FROM live GROUP BY folder_id)
SELECT fo.id AS folder_id, substr(fo.rel_path, length(l.rel_path) + 2) AS path, n FROM fo JOIN libraries l ON l.id = fo.library_id JOIN n ON n.folder_id = fo.id
WHERE fo.library_id = 1 AND starts_with(fo.rel_path, l.rel_path || '/')""")
def library_leaves(spark, d):
    n = files(spark, d, "folder_id").where("trashed_at is null").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    lib = table(spark, d, "libraries").where("id = 1").select(F.col("id").alias("library_id"), F.col("rel_path").alias("root"))
    mine = folders(spark, d, "library_id", "rel_path").join(lib, "library_id").where(F.startswith("rel_path", F.concat("root", F.lit("/"))))
    return mine.select(F.col("id").alias("folder_id"), F.expr("substr(rel_path, length(root) + 2)").alias("path")).join(n, "folder_id").select("folder_id", "path", "n")


@query("q19_folder_by_path", f"""{BASE}, p AS (SELECT rel_path, volume_uuid FROM fo WHERE id = 100)
SELECT arg_max(l.id, length(l.rel_path)) AS library_id FROM libraries l, p WHERE l.volume_uuid = p.volume_uuid AND (l.rel_path = '' OR l.rel_path = p.rel_path OR starts_with(p.rel_path, l.rel_path || '/'))""")
def folder_by_path(spark, d):
    """The deepest library a folder's path lies in."""
    p = folders(spark, d, "rel_path", "volume_uuid").where("id = 100").select(F.col("rel_path").alias("path"), "volume_uuid")
    inside = (F.col("rel_path") == "") | (F.col("rel_path") == F.col("path")) | F.startswith("path", F.concat("rel_path", F.lit("/")))
    return table(spark, d, "libraries").join(p, "volume_uuid").where(inside).agg(F.max_by("id", F.length("rel_path")).alias("library_id"))


@query("q21_smart_album", f"{BASE} SELECT id, rating, kind FROM live WHERE rating >= 3 AND kind = 0 AND favorite")
def smart_album(spark, d):
    """A stored filter, replayed."""
    f = c.Filter.from_json('{"min_rating": 3, "kind": 0, "favorite_only": true, "unknown": 1}')
    return c.apply(cat(spark, d, "rating", "kind", "favorite"), f).select("id", "rating", "kind")


@query("q24_trash", f"""{BASE}, t AS (SELECT f.size, fo.library_id FROM f JOIN fo ON fo.id = f.folder_id WHERE f.trashed_at IS NOT NULL)
SELECT l.id AS library_id, count(t.size) AS n, CAST(coalesce(sum(t.size), 0) AS BIGINT) AS bytes FROM libraries l LEFT JOIN t ON t.library_id = l.id GROUP BY l.id""")
def trash(spark, d):
    per = files(spark, d, "folder_id", "size").where("trashed_at is not null").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    lib = per.join(folders(spark, d, "library_id").select(F.col("id").alias("folder_id"), "library_id"), "folder_id").groupBy("library_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return table(spark, d, "libraries").select(F.col("id").alias("library_id")).join(lib, "library_id", "left").select("library_id", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n", "bytes")))


@query("q24_trash_pending", f"{BASE} SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM live WHERE culling_flag = 2")
def trash_pending(spark, d):
    return c.summary(cat(spark, d, "size", "culling_flag"), c.Filter(culling_flag=2))


@query("q31_event_date", f"{BASE} SELECT strftime(make_timestamp(min(taken_at) * 1000000), '%Y-%m-%d') AS event_date FROM f WHERE folder_id = 1")
def event_date(spark, d):
    return files(spark, d, "folder_id", "taken_at").where("folder_id = 1").agg(F.date_format(F.timestamp_seconds(F.min("taken_at")), "yyyy-MM-dd").alias("event_date"))


@query("q32_areas_of_selection", f"{BASE} SELECT DISTINCT fo.area, fo.library_id FROM f JOIN fo ON fo.id = f.folder_id WHERE f.rating >= 4")
def areas(spark, d):
    got = files(spark, d, "folder_id", "rating").where("rating >= 4").select("folder_id").distinct()
    return got.join(folders(spark, d, "area", "library_id").select(F.col("id").alias("folder_id"), "area", "library_id"), "folder_id").select("area", "library_id").distinct()


#: The filter's conditions, one query each: name, filter, columns read, condition in SQL.
FILTERS = [
    ("trashed", {"trashed": True}, ["trashed_at"], "f.trashed_at IS NOT NULL"),
    ("library", {"library_id": 1}, ["folder_id"], "f.folder_id IN (SELECT id FROM fo WHERE library_id = 1)"),
    ("area", {"area": 2}, ["folder_id"], "f.folder_id IN (SELECT id FROM fo WHERE area = 2)"),
    ("folder_path", {"folder_path": "photos/Travel-1"}, ["folder_id"], "f.folder_id IN (SELECT id FROM fo WHERE lower(rel_path) = 'photos/travel-1' OR starts_with(lower(rel_path), 'photos/travel-1/'))"),
    ("folder_id", {"folder_id": 12}, ["folder_id"], "f.folder_id IN (SELECT x.id FROM fo x, fo p WHERE p.id = 12 AND x.volume_uuid = p.volume_uuid AND (x.rel_path = p.rel_path OR starts_with(x.rel_path, p.rel_path || '/')))"),
    ("kind", {"kind": 1}, ["kind"], "f.kind = 1"),
    ("min_rating", {"min_rating": 4}, ["rating"], "f.rating >= 4"),
    ("culling_flag", {"culling_flag": 1}, ["culling_flag"], "f.culling_flag = 1"),
    ("year", {"year": "2015"}, ["taken_at"], "strftime(make_timestamp(f.taken_at * 1000000), '%Y') = '2015'"),
    ("month", {"month": "2016-12"}, ["taken_at"], "strftime(make_timestamp(f.taken_at * 1000000), '%Y-%m') = '2016-12'"),
    ("day", {"day": "2020-01-05"}, ["taken_at"], "strftime(make_timestamp(f.taken_at * 1000000), '%Y-%m-%d') = '2020-01-05'"),
    ("camera", {"camera": "Orbis P9"}, ["cam_model"], "f.cam_model = 'Orbis P9'"),
    ("no_camera", {"camera": ""}, ["cam_model"], "coalesce(f.cam_model, '') = ''"),
    ("no_place", {"place": ""}, ["gps_lat", "gps_lon"], f"NOT coalesce({GPS}, false)"),
    ("bad_place", {"place": "somewhere"}, ["kind"], "true"),
    ("favorite", {"favorite_only": True}, ["favorite"], "f.favorite"),
    ("bbox", {"bbox": "-20,0,50,90"}, ["gps_lat", "gps_lon"], f"{GPS} AND gps_lat BETWEEN -20 AND 50 AND gps_lon BETWEEN 0 AND 90"),
    ("bad_bbox", {"bbox": "50,0,-20,90"}, ["kind"], "true"),
    ("name_like", {"name_like": " IMG_1"}, ["name"], "contains(lower(f.name), 'img_1')"),
    ("several", {"kind": 0, "min_rating": 2, "area": 1, "year": "2014"}, ["kind", "rating", "folder_id", "taken_at"], "f.kind = 0 AND f.rating >= 2 AND f.folder_id IN (SELECT id FROM fo WHERE area = 1) AND strftime(make_timestamp(f.taken_at * 1000000), '%Y') = '2014'"),
]
for _n, _f, _cols, _sql in FILTERS:
    _live = "true" if _f.get("trashed") else "f.trashed_at IS NULL"
    query(f"f_{_n}", f"{BASE} SELECT f.id FROM f WHERE {_live} AND {_sql}")(lambda spark, d, f=_f, cols=_cols: c.apply(cat(spark, d, *cols), c.Filter(**f)).select("id"))


@query("h2_scroll_buckets", f"""{BASE}, m AS (SELECT strftime({_T}, '%Y-%m') AS month, count(*) AS n FROM live WHERE taken_at IS NOT NULL GROUP BY 1)
SELECT month, n, coalesce(CAST(sum(n) OVER (ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS first_row FROM m""")
def scroll_buckets(spark, d):
    """Where each month starts in the listing: running totals over the months, a few hundred rows."""
    m = files(spark, d, "taken_at").where("trashed_at is null and taken_at is not null").groupBy(F.date_format(F.timestamp_seconds("taken_at"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    return m.select("month", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first_row"))
