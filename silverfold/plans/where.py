"""Queries over places."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverfold.operators import places as g
from silverfold.operators.catalog import valid_gps
from silverfold.plans.browse import BASE, GPS, files
from silverfold.plans.problem_sql import P1
from silverfold.plans.registry import query
from silverfold.session import table

_KEY = "printf('%.2f,%.2f', floor(gps_lat * 100) / 100 + 0.0, floor(gps_lon * 100) / 100 + 0.0)"


@query("g01_cells", f"{BASE} SELECT {_KEY} AS cell, count(*) AS n FROM live WHERE {GPS} GROUP BY 1")
def cells(spark, d):
    got = files(spark, d, "gps_lat", "gps_lon").where("trashed_at is null").where(valid_gps())
    return got.groupBy(g.cell_key(F.col("gps_lat"), F.col("gps_lon")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("g02_cell_centers", f"{BASE}, k AS (SELECT DISTINCT {_KEY} AS cell FROM live WHERE {GPS}) SELECT cell, round(CAST(split_part(cell, ',', 1) AS DOUBLE) + 0.005, 6) AS lat, round(CAST(split_part(cell, ',', 2) AS DOUBLE) + 0.005, 6) AS lon FROM k")
def centers(spark, d):
    lat, lon = g.cell_center(F.col("cell"))
    return cells(spark, d).select("cell", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


MEDOID = f"{BASE}, k AS (SELECT {_KEY} AS cell, gps_lat, gps_lon, id FROM live WHERE {GPS}), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY gps_lat, gps_lon, id) AS r, count(*) OVER (PARTITION BY cell) AS n FROM k)"


@query("g03_medoids", f"{MEDOID} SELECT cell, gps_lat AS lat, gps_lon AS lon, n FROM r WHERE r = (n + 1) // 2")
def medoids(spark, d):
    return g.medoids(files(spark, d, "gps_lat", "gps_lon").where("trashed_at is null")).withColumn("n", F.col("n").cast("long"))


def _regions(spark, d):
    return table(spark, d, "geo_regions").withColumnRenamed("region_id", "id")


def _cities(spark, d):
    return table(spark, d, "geo_cities").select(F.col("city_id").alias("id"), "lat", "lon", F.col("cc").alias("code"), "name", F.col("admin1_name").alias("admin1"), F.col("population").alias("pop"))


def _cells(spark, d):
    return table(spark, d, "map_cells").where("not (lat = 0 and lon = 0)").select(F.col("cell_id").alias("id"), "lat", "lon")


_HEAD = P1.split("SELECT 'near' AS rel")[0]


@query("g05_nearest_city", _HEAD + "SELECT a_id AS cell_id, b_id AS city_id FROM best WHERE n = 1")
def nearest_city(spark, d):
    from silverfold.operators.nearby import nearby

    got = nearby(_cells(spark, d), _regions(spark, d), _cities(spark, d), near_km=None)
    return got.where("rel = 'city'").select(F.col("a_id").alias("cell_id"), F.col("b_id").alias("city_id"))


@query("g06_resolve", _HEAD + """, co AS (SELECT l.id, arg_min(g.code, (g.code, g.name)) AS cc, arg_min(g.name, (g.code, g.name)) AS country FROM lies l JOIN geo_regions g USING (region_id) WHERE g.level = 1 GROUP BY l.id),
pr AS (SELECT l.id, g.parent_code AS cc, min(g.name) AS poly FROM lies l JOIN geo_regions g USING (region_id) WHERE g.level = 2 GROUP BY ALL),
ci AS (SELECT b.a_id AS id, r.km, c.name AS cname, c.admin1_name AS cadmin FROM best b JOIN reach r ON r.a_id = b.a_id AND r.b_id = b.b_id JOIN geo_cities c ON c.city_id = b.b_id WHERE b.n = 1),
k AS (SELECT DISTINCT parent_code AS cc, name FROM geo_regions WHERE level = 2),
j AS (SELECT co.id, co.cc, country, poly, km, cname, cadmin, coalesce(km <= 5 AND EXISTS (SELECT 1 FROM k WHERE k.cc = co.cc AND k.name = cadmin) AND poly IS DISTINCT FROM cadmin, false) AS corrected, EXISTS (SELECT 1 FROM k WHERE k.cc = co.cc) AS has
  FROM co LEFT JOIN pr ON pr.id = co.id AND pr.cc = co.cc LEFT JOIN ci ON ci.id = co.id),
m AS (SELECT *, CASE WHEN corrected THEN cadmin WHEN has THEN poly ELSE nullif(trim(cadmin), '') END AS admin1 FROM j),
o AS (SELECT *, km IS NOT NULL AND (NOT has OR coalesce(cadmin = admin1, false)) AS borrow FROM m)
SELECT id AS cell_id, country, admin1, CASE WHEN borrow AND cname IS DISTINCT FROM admin1 THEN nullif(trim(cname), '') END AS admin2, CASE WHEN borrow THEN round(km, 6) END AS distance_km, CASE WHEN borrow OR corrected THEN 'approximate' ELSE 'boundary' END AS "precision" FROM o""")
def resolve(spark, d):
    got = g.resolve(_cells(spark, d), _regions(spark, d), _cities(spark, d))
    return got.withColumn("distance_km", F.round("distance_km", 6)).withColumnRenamed("id", "cell_id")


@query("g07_policy_zone", _HEAD.replace("p.id < q.id", "p.id < q.id AND false") + "SELECT id AS cell_id FROM c p, (SELECT lat, lon FROM geo_cities ORDER BY population DESC, city_id LIMIT 1) q WHERE 2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) <= 5")
def policy(spark, d):
    """Cells within 5 km of a fixed point, here the largest city."""
    at = table(spark, d, "geo_cities").orderBy(F.desc("population"), "city_id").select("lat", "lon").first()
    good = _cells(spark, d).where("lat between -90 and 90 and lon between -180 and 180 and not isnan(lat) and not isnan(lon)").distinct()
    return good.where(g.policy_zone(F.col("lat"), F.col("lon"), (at.lat, at.lon))).select(F.col("id").alias("cell_id"))


_PLAIN = "regexp_replace(regexp_replace(lower({}), '[\\s_-]', '', 'g'), '^(.+?)(특별자치도|특별자치시|특별시|광역시|자치도|자치시|teukbyeoljachido|teukbyeolsi|gwangyeoksi|do|si|도|시)$', '\\1')"
#: Provinces under three spellings; cities ask, each third in another spelling, of a province of their country.
_ALIASES = f"""WITH g AS (SELECT DISTINCT code, name, parent_code FROM geo_regions WHERE level = 2), a AS (SELECT DISTINCT code, {_PLAIN.format("alias")} AS plain FROM (SELECT code, unnest([name, upper(name) || '-do', replace(name, ' ', '_')]) AS alias FROM g)),
h AS (SELECT parent_code, list(code ORDER BY code) AS codes FROM g GROUP BY parent_code), c AS (SELECT DISTINCT city_id, cc, admin1_name FROM geo_cities),
q AS (SELECT city_id, codes[CAST(city_id % len(codes) AS INT) + 1] AS here, {_PLAIN.format("CASE WHEN city_id % 3 = 0 THEN admin1_name || ' Do' ELSE admin1_name END")} AS plain FROM c LEFT JOIN h ON parent_code = cc),
v AS (SELECT city_id, here, CASE WHEN here IS NOT NULL AND plain <> '' AND EXISTS (SELECT 1 FROM a WHERE a.code = here AND a.plain = q.plain) THEN true WHEN here IS NOT NULL AND plain <> '' AND EXISTS (SELECT 1 FROM a WHERE a.plain = q.plain) THEN false END AS matches FROM q)"""


def _province_matches(spark, d):
    p = table(spark, d, "geo_regions").where("level = 2").select("code", "name", "parent_code").distinct()
    aliases = p.select("code", F.explode(F.array("name", F.concat(F.upper("name"), F.lit("-do")), F.replace("name", F.lit(" "), F.lit("_")))).alias("alias"))
    codes = p.groupBy(F.col("parent_code").alias("cc")).agg(F.array_sort(F.collect_list("code")).alias("codes"))  # a fixed table of provinces
    c = table(spark, d, "geo_cities").select("city_id", "cc", "admin1_name").distinct().join(codes, "cc", "left")
    name = F.when(F.col("city_id") % 3 == 0, F.concat("admin1_name", F.lit(" Do"))).otherwise(F.col("admin1_name"))
    return g.match_regions(c.select(F.col("city_id").alias("id"), name.alias("name"), F.get("codes", (F.col("city_id") % F.size("codes")).cast("int")).alias("here")), aliases)


@query("g08_region_names", f"{_ALIASES} SELECT city_id, matches FROM v")
def region_names(spark, d):
    """Whether the province a city names is the one asked of: yes, another known one, or not to be told."""
    return _province_matches(spark, d).withColumnRenamed("id", "city_id")


@query("g11_judge_provinces", f"{_ALIASES} SELECT city_id, CASE WHEN coalesce(NOT matches, false) THEN 'conflict' WHEN city_id % 4 < 2 THEN 'shallow' ELSE 'accept' END AS verdict FROM v")
def judge_provinces(spark, d):
    """Answers judged by their province; of four one in two is shallower than what is known."""
    m = _province_matches(spark, d)
    return m.select(F.col("id").alias("city_id"), g.judge(F.lit("XX"), F.lit("xx"), F.col("matches"), F.col("id") % 4, F.lit(2)).alias("verdict"))


_NAMED = f"""{MEDOID}, place AS (SELECT cell, min(cell || '*') AS place FROM r WHERE n >= 2 GROUP BY cell)"""


@query("g09_spread", f"{_NAMED} SELECT live.id, place.place FROM live LEFT JOIN place ON {GPS} AND place.cell = {_KEY}")
def spread(spark, d):
    """Files take the name of their cell; here cells of two or more files have one."""
    f = files(spark, d, "gps_lat", "gps_lon").where("trashed_at is null")
    named = g.medoids(f).where("n >= 2").select("cell", F.concat("cell", F.lit("*")).alias("place"))
    return g.spread(f, named)


@query("g10_stats", f"""{BASE}, k AS (SELECT {_KEY} AS cell, count(*) AS n FROM live WHERE {GPS} GROUP BY 1)
SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS files, count(*) FILTER (n = 1) AS single, count(*) FILTER (n >= 10) AS busy, CAST(sum(n) FILTER (n >= 10) AS BIGINT) AS busy_files, max(n) AS largest, (SELECT count(*) FROM live WHERE NOT coalesce({GPS}, false)) AS unplaced FROM k""")
def stats(spark, d):
    """Conditional totals, over one row a cell."""
    f = files(spark, d, "gps_lat", "gps_lon").where("trashed_at is null")
    key = F.when(valid_gps(), g.cell_key(F.col("gps_lat"), F.col("gps_lon")))
    k = f.groupBy(key.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    there, n = F.col("cell").isNotNull(), F.col("n")
    return k.agg(
        F.count_if(there).alias("cells"), F.sum(F.when(there, n)).alias("files"), F.count_if(there & (n == 1)).alias("single"), F.count_if(there & (n >= 10)).alias("busy"),
        F.sum(F.when(there & (n >= 10), n)).alias("busy_files"), F.max(F.when(there, n)).alias("largest"), F.coalesce(F.sum(F.when(~there, n)), F.lit(0)).alias("unplaced"),
    )


@query("g11_judge", """WITH m AS (SELECT DISTINCT cell_id, country, place, places FROM map_cells) SELECT cell_id, CASE WHEN country IS NULL THEN CASE WHEN places < 2 THEN 'shallow' ELSE 'accept' END
  WHEN place IS NULL THEN 'shallow' WHEN upper(substr(place, 1, 2)) <> upper(country) THEN 'conflict' WHEN places < 2 THEN 'shallow' ELSE 'accept' END AS verdict FROM m""")
def judge(spark, d):
    """Earlier answers judged; the first two letters of the place stand for the answer's country."""
    m = table(spark, d, "map_cells").select("cell_id", "country", "place", "places").distinct()
    return m.select("cell_id", g.judge(F.col("country"), F.substring("place", 1, 2), F.lit(None).cast("boolean"), F.col("places"), F.lit(2)).alias("verdict"))


#: Addresses of six shapes, by event: parts that tell the levels and their order apart.
_ADDRESSES = [
    {"country": "X", "city": "t"}, {"state": "t", "province": "k", "city": "C"}, {"state_district": "t", "village": "k", "suburb": "U"},
    {"city": "t", "borough": "k", "country": "Y"}, {"county": "t", "town": "T", "city": "k"}, {"state": " ", "region": "t", "city": "t", "suburb": "k"},
]


@query("g12_fold_address", """WITH e AS (SELECT event_id, event_type AS t, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'X' WHEN 3 THEN 'Y' END AS country, CASE event_id % 6 WHEN 4 THEN k ELSE t END AS admin1,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'C' WHEN 2 THEN k WHEN 3 THEN nullif(k, t) WHEN 4 THEN CASE WHEN t <> k THEN t ELSE 'T' END ELSE nullif(k, t) END AS admin2 FROM e""")
def fold(spark, d):
    """Address parts in JSON folded to levels."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("t"), F.get_json_object("props", "$.k").alias("k"))
    shape = lambda parts: F.to_json(F.struct(*((F.col(v) if v in "tk" else F.lit(v)).alias(c) for c, v in parts.items())))
    address = F.element_at(F.array(*map(shape, _ADDRESSES)), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", g.fold_address(address).alias("a")).select("event_id", "a.country", "a.admin1", "a.admin2")


@query("g13_depth", "WITH m AS (SELECT DISTINCT cell_id, country, geo_precision, place FROM map_cells) SELECT cell_id, coalesce(place, geo_precision, country) AS name, CASE WHEN place IS NOT NULL THEN 3 WHEN geo_precision IS NOT NULL THEN 2 WHEN country IS NOT NULL THEN 1 ELSE 0 END AS depth FROM m")
def depth(spark, d):
    m = table(spark, d, "map_cells").select("cell_id", "country", "geo_precision", "place").distinct()
    cols = (F.col("country"), F.col("geo_precision"), F.col("place"))
    return m.select("cell_id", g.narrowest(*cols).alias("name"), g.depth(*cols).alias("depth"))


@query("g14_zoom", "SELECT CAST(z AS INT) AS zoom, CASE WHEN z < 5 THEN 1.0 WHEN z < 9 THEN 0.1 WHEN z < 13 THEN 0.01 ELSE 0.001 END::DOUBLE AS precision FROM range(0, 20) t(z)")
def zoom(spark, d):
    return spark.range(20).select(F.col("id").cast("int").alias("zoom"), g.zoom_precision(F.col("id")).alias("precision"))
