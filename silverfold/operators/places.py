"""Places of pictures: grid cells, one position a cell, names from regions and cities, and their spread to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverfold.operators.catalog import valid_gps
from silverfold.operators.nearby import RADIUS_KM, nearby

#: Endings of province names that are left away when names are compared (fixed values).
PROVINCE_ENDINGS = ["특별자치도", "특별자치시", "특별시", "광역시", "자치도", "자치시", "teukbyeoljachido", "teukbyeolsi", "gwangyeoksi", "do", "si", "도", "시"]


def cell_key(lat: Column, lon: Column) -> Column:
    """The 0.01-degree cell of a position, as text of its south-west corner."""
    down = lambda x: F.floor(x * 100) / 100 + F.lit(0.0)
    return F.format_string("%.2f,%.2f", down(lat), down(lon))


def cell_center(key: Column) -> tuple[Column, Column]:
    part = F.split(key, ",")
    return part[0].cast("double") + 0.005, part[1].cast("double") + 0.005


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.asin(F.least(F.sqrt(a), F.lit(1.0))) * (2 * radius)


def medoids(files: DataFrame) -> DataFrame:
    """One real position a cell: the lower middle by (lat, lon): ``cell, lat, lon, n``.

    Equal positions are counted first, so a cell is as large as its distinct positions.
    """
    spots = files.where(valid_gps()).groupBy(cell_key(F.col("gps_lat"), F.col("gps_lon")).alias("cell"), "gps_lat", "gps_lon").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("cell").orderBy("gps_lat", "gps_lon")
    s = spots.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(Window.partitionBy("cell")))
    middle = F.expr("(n + 1) div 2")
    return s.where((F.col("upto") >= middle) & (F.col("upto") - F.col("k") < middle)).select("cell", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), "n")


def resolve(points: DataFrame, regions: DataFrame, cities: DataFrame, district_km: float = 20.0, trust_km: float = 5.0) -> DataFrame:
    """Names of points ``id, lat, lon``: ``id, country, admin1, admin2, distance_km, precision``.

    The country is the level-1 region a point lies in, the province the level-2 region of that country. A city of the country
    within ``trust_km`` that names another province of it wins over the polygon. The district
    is the nearest city's name, from the same province only where the country has provinces, and not
    if it is the province's own name. Points in no country have no row.

    ``regions`` has ``id, code, name, level, parent_code, bbox, polys``; ``cities`` has
    ``id, lat, lon, code, name, admin1, pop``.
    """
    found = nearby(points, regions.select("id", "code", "level", "bbox", "polys"), cities.select("id", "lat", "lon", "code", "pop"), near_km=None, city_km=district_km)
    names = regions.select(F.col("id").alias("b_id"), "code", F.col("name").alias("rname"), "level", "parent_code").distinct()
    lies = found.where("rel = 'in'").join(names, "b_id")
    country = lies.where("level = 1").groupBy("a_id").agg(F.min(F.struct("code", "rname")).alias("c")).select("a_id", F.col("c.code").alias("cc"), F.col("c.rname").alias("country"))
    province = lies.where("level = 2").groupBy("a_id", F.col("parent_code").alias("cc")).agg(F.min("rname").alias("poly"))
    city = found.where("rel = 'city'").select("a_id", "b_id", "km").join(cities.select(F.col("id").alias("b_id"), F.col("name").alias("cname"), F.col("admin1").alias("cadmin")), "b_id").select("a_id", "km", "cname", "cadmin")
    known = names.where("level = 2").select(F.col("parent_code").alias("cc"), F.col("rname").alias("cadmin"), F.lit(True).alias("is_province")).distinct()
    has = names.where("level = 2").select(F.col("parent_code").alias("cc"), F.lit(True).alias("has")).distinct()
    j = country.join(province, ["a_id", "cc"], "left").join(city, "a_id", "left").join(known, ["cc", "cadmin"], "left").join(has, "cc", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    corrected = yes("is_province") & (F.col("km") <= trust_km) & ~F.coalesce(F.col("cadmin") == F.col("poly"), F.lit(False))
    j = j.withColumn("corrected", F.coalesce(corrected, F.lit(False)))
    admin1 = F.when(F.col("corrected"), F.col("cadmin")).when(yes("has"), F.col("poly")).otherwise(F.nullif(F.trim("cadmin"), F.lit("")))
    j = j.withColumn("admin1", admin1)
    near = F.col("km").isNotNull() & (~yes("has") | F.coalesce(F.col("cadmin") == F.col("admin1"), F.lit(False)))
    j = j.withColumn("borrow", near)
    return j.select(
        F.col("a_id").alias("id"), "country", "admin1", F.when(F.col("borrow") & ~F.coalesce(F.col("cname") == F.col("admin1"), F.lit(False)), F.nullif(F.trim("cname"), F.lit(""))).alias("admin2"),
        F.when(F.col("borrow"), F.col("km")).alias("distance_km"), F.when(F.col("borrow") | F.col("corrected"), "approximate").otherwise("boundary").alias("precision"),
    )


def policy_zone(lat: Column, lon: Column, at: tuple[float, float], km: float = 5.0) -> Column:
    """Whether a position lies in the circle around a fixed point that forces its region."""
    return haversine(lat, lon, F.lit(at[0]), F.lit(at[1])) <= km


def plain_region(name: Column) -> Column:
    """A region's name for comparison: small letters, no spaces or dashes, no administrative ending."""
    s = F.lower(F.regexp_replace(name, r"[\s_-]", ""))
    return F.regexp_replace(s, "^(.+?)(" + "|".join(PROVINCE_ENDINGS) + ")$", "$1")


def region_matches(name: Column, here: Column, all_names: Column) -> Column:
    """Whether a name means this region: true, false if it means another known one, else null."""
    n = plain_region(name)
    return F.when(here.isNull(), F.lit(None)).when(n == plain_region(here), True).when(F.array_contains(F.transform(all_names, plain_region), n), False)


def match_regions(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """Whether names mean the region they are asked of: ``id, matches``, true, false if they mean another known region, else null.

    ``asked`` has ``id, name, here`` (a region's code, or null), ``aliases`` has ``code, alias``, every way a region is called.
    Compared are plain names; an empty one means nothing. A name both of the region and of another is the region's.
    """
    a = asked.select("id", "here", plain_region(F.col("name")).alias("plain"))
    known = aliases.where("code is not null").select("code", plain_region(F.col("alias")).alias("plain")).where("plain <> ''").distinct()
    mine = known.select(F.col("code").alias("here"), "plain", F.lit(True).alias("__mine"))
    any_one = known.select("plain", F.lit(True).alias("__any")).distinct()
    j = a.join(mine, ["here", "plain"], "left").join(any_one, "plain", "left")
    return j.select("id", F.when(F.col("here").isNotNull() & F.col("__mine"), True).when(F.col("here").isNotNull() & F.col("__any"), False).alias("matches"))


def spread(files: DataFrame, named: DataFrame) -> DataFrame:
    """Gives files without a place that of their cell: ``id, place``. ``named`` has ``cell, place``."""
    f = files.withColumn("cell", F.when(valid_gps(), cell_key(F.col("gps_lat"), F.col("gps_lon"))))
    return f.join(named.where("place is not null").select("cell", "place"), "cell", "left").select("id", "place")


def judge(boundary_cc: Column, answer_cc: Column, admin1_ok: Column, new_depth: Column, old_depth: Column) -> Column:
    """What to do with an answer from elsewhere: conflict, shallow or accept.

    A known country isn't given up for another, or for an answer that names none, nor a
    known province for another known one, nor a deeper name for a shallower.
    """
    return (
        F.when(boundary_cc.isNotNull() & answer_cc.isNotNull() & (F.lower(boundary_cc) != F.lower(answer_cc)), "conflict")
        .when(boundary_cc.isNotNull() & answer_cc.isNull(), "shallow")
        .when(F.coalesce(~admin1_ok, F.lit(False)), "conflict")
        .when(new_depth < old_depth, "shallow")
        .otherwise("accept")
    )


def depth(country: Column, admin1: Column, admin2: Column) -> Column:
    return F.when(admin2.isNotNull(), 3).when(admin1.isNotNull(), 2).when(country.isNotNull(), 1).otherwise(0)


def narrowest(country: Column, admin1: Column, admin2: Column) -> Column:
    return F.coalesce(admin2, admin1, country)


#: Parts of an address by level, fixed values in the order they are looked at.
ADDRESS_WIDE = ["state", "province", "region", "state_district"]
ADDRESS_NARROW = ["city", "county", "municipality", "town", "borough", "city_district", "village", "suburb"]


def fold_address(address: Column) -> Column:
    """Country, admin1 and admin2 out of an address in JSON, and its country code.

    admin1 is the first wide part. Narrow parts count once, and not where they repeat admin1. Where
    no wide part is there, the first narrow one is admin1 and the second admin2.
    """
    get = lambda k: F.nullif(F.trim(F.get_json_object(address, f"$.{k}")), F.lit(""))
    wide = F.coalesce(*map(get, ADDRESS_WIDE))
    narrow = F.array_distinct(F.array_compact(F.array(*map(get, ADDRESS_NARROW))))
    narrow = F.filter(narrow, lambda x: ~x.eqNullSafe(wide))
    first, second = F.get(narrow, F.lit(0)), F.get(narrow, F.lit(1))
    return F.struct(
        get("country").alias("country"), F.coalesce(wide, first).alias("admin1"), F.when(wide.isNull(), second).otherwise(first).alias("admin2"), F.upper(get("country_code")).alias("cc")
    )


def zoom_precision(zoom: Column) -> Column:
    return F.when(zoom < 5, 1.0).when(zoom < 9, 0.1).when(zoom < 13, 0.01).otherwise(0.001)


def safe_bbox(south: Column, west: Column, north: Column, east: Column) -> Column:
    """A box in range; one that reaches over the antimeridian takes all longitudes."""
    over = (west < -180) | (east > 180) | (west > east)
    return F.struct(F.greatest(south, F.lit(-90.0)).alias("south"), F.when(over, -180.0).otherwise(west).alias("west"), F.least(north, F.lit(90.0)).alias("north"), F.when(over, 180.0).otherwise(east).alias("east"))
