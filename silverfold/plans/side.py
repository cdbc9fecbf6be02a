"""Queries over what the test tables lack: thumbnails, tags, faces, another store, place columns, pictures.

Each side table is a small function of the files, the same in Spark and in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverfold.functions import content, dates
from silverfold.operators import catalog as c
from silverfold.operators import cull, ledger, trees, vectors
from silverfold.plans.browse import BASE, GPS, files, folders
from silverfold.plans.registry import query
from silverfold.session import Stages, shared_folder, table
from silverfold.sources import media

_GPS = f"coalesce({GPS}, false)"
#: Places and lens of a file.
WIDE = {
    "country": f"CASE WHEN {_GPS} THEN 'Land ' || CAST(CAST(floor((gps_lat + 90) / 45) AS INT) AS {{text}}) END",
    "admin1": f"CASE WHEN {_GPS} AND id % 4 <> 0 THEN 'Area ' || CAST(CAST(floor((gps_lon + 180) / 30) AS INT) AS {{text}}) END",
    "admin2": f"CASE WHEN {_GPS} AND id % 4 = 1 THEN 'Town ' || CAST(folder_id % 20 AS {{text}}) END",
    "lens": "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE coalesce(cam_model, 'Plain') || ' lens' END",
}
THUMBS = "SELECT id AS file_id, CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END AS state, size + CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS size, modified_at FROM f WHERE id % 3 <> 0"
TAGS = "SELECT id AS file_id, rating AS tag_id FROM f WHERE rating > 0 UNION ALL SELECT id AS file_id, 100 + kind AS tag_id FROM f WHERE favorite"
NAS = "SELECT id AS file_id FROM f WHERE quick_hash IS NOT NULL AND id % 2 = 0"
FACES = "SELECT 2 * id + k AS face_id, id AS file_id, CASE WHEN id % 9 <> 0 THEN id % 40 END AS person_id, '{{\"w\": 0.' || lpad(CAST((id * 7919 + k * 31) % 1000 AS {text}), 3, '0') || '}}' AS bbox FROM f {cross} WHERE id % 6 = 0 AND k <= id % 4"
SIDES = f""", fw AS (SELECT *, {", ".join(f"{e.format(text='VARCHAR')} AS {n}" for n, e in WIDE.items())} FROM f),
thumbs AS ({THUMBS}), tags AS ({TAGS}), nas AS ({NAS}), faces AS ({FACES.format(text="VARCHAR", cross="CROSS JOIN (VALUES (0), (1)) k(k)")})"""
FULL = BASE.rstrip() + SIDES


def wide(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d, "folder_id", "name", "size", "kind", "rating", "favorite", "taken_at", "cam_model", "gps_lat", "gps_lon", "quick_hash", "modified_at")
    return f.withColumns({n: F.expr(e.format(text="STRING")) for n, e in WIDE.items()})


def _of_files(f: DataFrame, sql: str) -> DataFrame:
    return f.sparkSession.sql(sql.replace("FROM f", "FROM {f}"), f=f)


def full_catalog(spark: SparkSession, d: str) -> c.Catalog:
    f = wide(spark, d)
    faces = f.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return c.Catalog(
        f, folders(spark, d, "library_id", "area", "rel_path", "volume_uuid", "name"), thumbs=_of_files(f, THUMBS), file_tags=_of_files(f, TAGS), nas_state=_of_files(f, NAS),
        faces=_of_files(faces, FACES.format(text="STRING", cross="").replace("{", "{{").replace("}", "}}")),
    )


#: Conditions on side tables and columns: name, filter, condition in SQL.
MORE_FILTERS = [
    ("country", {"country": "Land 2"}, "country = 'Land 2'"),
    ("no_country", {"country": ""}, "country IS NULL"),
    ("admin1", {"admin1": "Area 10"}, "admin1 = 'Area 10'"),
    ("no_admin1", {"admin1": ""}, "admin1 IS NULL"),
    ("admin2", {"admin2": "Town 7"}, "admin2 = 'Town 7'"),
    ("no_admin2", {"admin2": ""}, "admin2 IS NULL"),
    ("lens", {"lens": "Orbis P9 lens"}, "lens = 'Orbis P9 lens'"),
    ("no_lens", {"lens": ""}, "coalesce(lens, '') = ''"),
    ("tag", {"tag_id": 4}, "id IN (SELECT file_id FROM tags WHERE tag_id = 4)"),
    ("unknown_tag", {"tag_id": 999}, "false"),
    ("no_thumb", {"no_thumb": True}, "id NOT IN (SELECT file_id FROM thumbs WHERE state = 1)"),
    ("nas", {"nas": True}, "id IN (FROM nas)"),
    ("not_nas", {"nas": False}, "id NOT IN (FROM nas)"),
    ("person", {"person_id": 12}, "id IN (SELECT file_id FROM faces WHERE person_id = 12)"),
    ("place", {"place": "35.4,104.1"}, f"{_GPS} AND gps_lat >= 35.4 AND gps_lat < 35.5 AND gps_lon >= 104.1 AND gps_lon < 104.2"),
]
for _n, _f, _sql in MORE_FILTERS:
    query(f"f_{_n}", f"{FULL} SELECT id FROM fw WHERE trashed_at IS NULL AND {_sql}")(lambda spark, d, f=_f: c.apply(full_catalog(spark, d), c.Filter(**f)).select("id"))

for _kind in ("lens", "country", "admin1", "admin2"):
    query(f"q10_facet_{_kind}", f"{FULL} SELECT coalesce({_kind}, '') AS value, count(*) AS n FROM fw WHERE trashed_at IS NULL AND rating >= 2 GROUP BY 1 ORDER BY n DESC, value LIMIT 200")(
        lambda spark, d, kind=_kind: c.facet(full_catalog(spark, d), c.Filter(min_rating=2), kind)
    )


@query("q01_page_rows", f"""{FULL} SELECT fw.id, fw.name, fo.name AS folder, fo.rel_path, fo.area, t.file_id IS NOT NULL AS has_thumb, coalesce(taken_at, 0) AS sort_key
FROM fw JOIN fo ON fo.id = fw.folder_id LEFT JOIN thumbs t ON t.file_id = fw.id AND t.state = 1 WHERE trashed_at IS NULL ORDER BY sort_key DESC, fw.id DESC LIMIT 201""")
def page_rows(spark, d):
    """A page as it is shown: with its folders and whether a thumbnail is there."""
    return c.page_rows(full_catalog(spark, d), c.Filter(), 200).select("id", "name", "folder", "rel_path", "area", "has_thumb", "sort_key")


@query("q15_library_stats", f"""{FULL}, v AS (SELECT fo.library_id, f.id, f.size, t.file_id IS NOT NULL AS done FROM f JOIN fo ON fo.id = f.folder_id LEFT JOIN thumbs t ON t.file_id = f.id AND t.state = 1 WHERE trashed_at IS NULL)
SELECT l.id AS library_id, count(v.id) AS files, CAST(coalesce(sum(v.size), 0) AS BIGINT) AS bytes, count(v.id) FILTER (done) AS thumbs_done, count(v.id) FILTER (NOT done) AS thumbs_pending
FROM (SELECT DISTINCT id FROM libraries) l LEFT JOIN v ON v.library_id = l.id GROUP BY l.id""")
def library_stats(spark, d):
    k = full_catalog(spark, d)
    return c.library_stats(k, table(spark, d, "libraries"))


@query("q20_tags", f"{FULL} SELECT tag_id, count(f.id) AS n FROM tags LEFT JOIN f ON f.id = file_id AND f.trashed_at IS NULL GROUP BY tag_id")
def tags(spark, d):
    """Tags with their live files, most used first."""
    k = full_catalog(spark, d)
    live = k.files.where("trashed_at is null").select(F.col("id").alias("file_id"), F.lit(1).alias("live"))
    n = k.file_tags.join(live, "file_id", "left").groupBy("tag_id").agg(F.count("live").alias("n"))
    return n.orderBy(F.desc("n"), "tag_id")


@query("q20_tags_of_files", f"{FULL} SELECT file_id, string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY tag_id) AS tags FROM tags GROUP BY file_id")
def tags_of_files(spark, d):
    t = full_catalog(spark, d).file_tags
    return t.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("tag_id")).cast("array<string>"), ",").alias("tags"))


@query("q22_people", f"""{FULL}, l AS (SELECT faces.*, CAST(json_extract(bbox, '$.w') AS DOUBLE) AS w, f.trashed_at IS NULL AND t.file_id IS NOT NULL AS shown FROM faces JOIN f ON f.id = file_id LEFT JOIN thumbs t ON t.file_id = f.id AND t.state = 1 WHERE person_id IS NOT NULL)
SELECT person_id, count(*) AS faces, arg_max(face_id, (w, -face_id)) FILTER (shown) AS cover FROM l GROUP BY person_id""")
def people_list(spark, d):
    """People by their faces; the cover is the widest face on a live file with a thumbnail."""
    k = full_catalog(spark, d)
    return vectors.people_list(k.faces, k.files, k.thumbs)


@query("v06_rename_people", "WITH p AS (SELECT DISTINCT label AS person_id FROM embeddings) SELECT person_id, CASE WHEN person_id % 3 <> 0 THEN 'Name ' || person_id END AS name FROM p")
def rename_people(spark, d):
    """New names of people; a blank one takes the name away."""
    p = table(spark, d, "embeddings").select(F.col("label").alias("person_id")).distinct().withColumn("name", F.lit("old"))
    text = F.when(F.col("person_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Name "), F.col("person_id").cast("string")))
    return vectors.rename_people(p, p.select("person_id", text.alias("name")))


@query("v06_merge_people", "SELECT vec_id AS id, CASE WHEN label % 4 = 1 THEN label - 1 ELSE label END AS person_id FROM embeddings")
def merge_people(spark, d):
    """Every fourth person is merged into the one before."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("person_id"))
    merges = e.where("person_id % 4 = 1").select(F.col("person_id").alias("from_id"), (F.col("person_id") - 1).alias("to_id")).distinct()
    return vectors.merge_people(e, merges).select("id", "person_id")


_M = "WITH m AS (SELECT DISTINCT group_id, file_id, size, area, is_best, library_id, name, folder_id, culling_flag, CASE WHEN group_id % 5 = 0 THEN 1 ELSE 0 END AS state, group_id % 3 AS kind FROM member_rows)"


def _cull_members(spark, d):
    m = table(spark, d, "member_rows").select("group_id", "file_id", "size", "area", "is_best", "library_id", "name", "folder_id", "culling_flag").distinct()
    return m.withColumns({"state": F.when(F.col("group_id") % 5 == 0, 1).otherwise(0), "kind": (F.col("group_id") % 3).cast("int")})


@query("q25_groups_scoped", f"""{_M}, g AS (SELECT group_id, any_value(state) AS state, any_value(kind) AS kind, CAST(sum(size) AS BIGINT) AS size_bytes, count(*) AS n,
  bool_or(NOT coalesce(is_best, false) AND coalesce(area, 0) IN (1, 2)) AS settled, bool_or(coalesce(library_id, 0) = 1 AND (kind = 1 OR NOT coalesce(is_best, false))) AS here,
  arg_min(name, (CASE WHEN coalesce(is_best, false) THEN 0 ELSE 1 END, file_id)) AS cover FROM m GROUP BY group_id)
SELECT group_id, n, size_bytes, cover FROM g WHERE kind = 0 AND state = 0 AND here AND settled ORDER BY size_bytes DESC, group_id LIMIT 50 OFFSET 5""")
def groups_scoped(spark, d):
    """Open groups of a kind that would drop settled files of a library: a later page of the list."""
    return cull.list_groups(_cull_members(spark, d), kind=0, done=False, library_id=1, settled_only=True, limit=50, offset=5)


_APPLY = """, g AS (SELECT group_id, any_value(kind) AS kind, any_value(state) AS state, bool_or(library_id = 1 AND NOT coalesce(is_best, false)) AS here, bool_or(coalesce(area, 0) IN (1, 2) AND NOT coalesce(is_best, false)) AS loses, bool_or(coalesce(area, 0) IN (1, 2)) AS any_settled FROM m GROUP BY group_id),
todo AS (SELECT group_id, any_settled, loses FROM g WHERE kind = {kind} AND state = 0 AND coalesce(here, false))"""


@query("e27_apply_scope", f"""{_M}{_APPLY.format(kind=2)}, t AS (SELECT * FROM todo) SELECT m.group_id, file_id, culling_flag AS old_flag, CASE WHEN coalesce(is_best, false) THEN 1 ELSE 2 END AS new_flag
FROM m JOIN t USING (group_id) WHERE culling_flag <> CASE WHEN coalesce(is_best, false) THEN 1 ELSE 2 END AND NOT (culling_flag = 1 AND NOT coalesce(is_best, false))""")
def apply_scope(spark, d):
    """All open groups of a kind of which a library would lose a file."""
    return cull.apply_all(_cull_members(spark, d), kind=2, library_id=1)


@query("e27_apply_junk", f"""{_M}{_APPLY.format(kind=1)} SELECT m.group_id, file_id, culling_flag AS old_flag, 2 AS new_flag FROM m JOIN todo USING (group_id) WHERE coalesce(area, 0) NOT IN (1, 2) AND culling_flag NOT IN (1, 2)""")
def apply_junk(spark, d):
    """Junk has no best: all of a group but its settled files go."""
    return cull.apply_all(_cull_members(spark, d), kind=1, library_id=1, skip_settled=True)


@query("e27_dry_run", " UNION ALL ".join(f"""SELECT * FROM ({_M}{_APPLY.format(kind=k)}
SELECT {k} AS kind, (SELECT count(*) FROM todo {"" if k == 1 else "WHERE NOT loses"}) AS groups, {"0" if k == 1 else "(SELECT count(DISTINCT file_id) FROM m JOIN todo USING (group_id) WHERE NOT loses AND coalesce(is_best, false))"} AS kept,
(SELECT count(DISTINCT file_id) FROM m JOIN todo USING (group_id) WHERE {"coalesce(area, 0) NOT IN (1, 2)" if k == 1 else "NOT loses AND NOT coalesce(is_best, false)"}) AS rejected,
{"(SELECT count(DISTINCT file_id) FROM m JOIN todo USING (group_id) WHERE coalesce(area, 0) IN (1, 2))" if k == 1 else "(SELECT count(*) FROM todo WHERE loses)"} AS skipped)""" for k in (0, 1, 2)))
def dry_run(spark, d):
    """What applying all groups of each kind would do, in numbers."""
    m = _cull_members(spark, d)
    out = [cull.dry_run(m, kind=k, library_id=1, skip_settled=True) for k in (0, 1, 2)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("e29_skip", f"{_M} SELECT DISTINCT group_id, CASE WHEN state = 0 AND group_id % 2 = 0 THEN 2 ELSE state END AS state FROM m")
def skip(spark, d):
    """Groups put aside: an open one is skipped, a closed one stays."""
    g = _cull_members(spark, d).select("group_id", "state").distinct()
    return cull.skip(g, g.where("group_id % 2 = 0").select("group_id"))


@query("e29_unmark", f"{_M}, u AS (SELECT file_id FROM m WHERE file_id % 4 = 0), g AS (SELECT DISTINCT group_id FROM m JOIN u USING (file_id)) SELECT DISTINCT m.group_id, CASE WHEN state = 1 AND kind = 0 AND g.group_id IS NOT NULL THEN 0 ELSE state END AS state FROM m LEFT JOIN g USING (group_id)")
def unmark(spark, d):
    """Files taken out of the trash list: closed duplicate groups they are in are opened again."""
    m = _cull_members(spark, d)
    return cull.reopen(m, m.where("file_id % 4 = 0").select("file_id"), kind=0)


@query("s11_fresh_thumbs", f"{FULL} SELECT id FROM live WHERE NOT EXISTS (SELECT 1 FROM thumbs t WHERE t.file_id = live.id AND t.state = 1 AND t.size = live.size AND t.modified_at IS NOT DISTINCT FROM live.modified_at)")
def fresh_thumbs(spark, d):
    """Files whose thumbnail is missing, failed, or older than the file."""
    k = full_catalog(spark, d)
    return ledger.stale_thumbs(k.files, k.thumbs).select("id")


@query("l07_purge_latest", f"""{BASE}, j AS (SELECT id AS file_id, n, CASE WHEN (id + n) % 3 = 0 THEN 'failed' ELSE 'uploaded' END AS result FROM f, range(3) t(n) WHERE trashed_at IS NOT NULL AND id % 4 <> 0 AND n <= id % 3), l AS (SELECT file_id, arg_max(result, n) AS result FROM j GROUP BY file_id)
SELECT id, CASE WHEN NOT (scanned_at > trashed_at) THEN 'pending' WHEN culling_flag = 2 THEN 'discarded' WHEN coalesce(result = 'uploaded', false) THEN 'uploaded' ELSE 'unknown' END AS class FROM f LEFT JOIN l ON file_id = id WHERE trashed_at IS NOT NULL""")
def purge_latest(spark, d):
    """What trashed files are, by the latest journal row of each."""
    f = files(spark, d, "culling_flag", "scanned_at").where("trashed_at is not null")
    n = F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))).alias("n")
    j = f.where("id % 4 <> 0").select(F.col("id").alias("file_id"), n).withColumn("result", F.when((F.col("file_id") + F.col("n")) % 3 == 0, "failed").otherwise("uploaded"))
    last = ledger.latest(j, "file_id", "n").select(F.col("file_id").alias("id"), "result")
    return f.join(last, "id", "left").select("id", ledger.purge_class(F.col("culling_flag"), F.coalesce(F.col("result") == "uploaded", F.lit(False)), F.col("scanned_at") > F.col("trashed_at")).alias("class"))


@query("t03_name_times", f"""{BASE} SELECT id, CAST(CASE id % 6 WHEN 4 THEN taken_at - taken_at % 86400 WHEN 5 THEN NULL ELSE taken_at END AS BIGINT) AS t FROM live WHERE taken_at IS NOT NULL""")
def name_times(spark, d):
    """Times out of file names of six spellings, made of the files' own times; the fifth tells a day alone, the last nothing."""
    f = files(spark, d, "taken_at").where("trashed_at is null and taken_at is not null")
    at = F.timestamp_seconds("taken_at")
    names = [F.date_format(at, p) for p in ("'IMG_'yyyyMMdd_HHmmss'.jpg'", "yyyy-MM-dd HH.mm.ss'.png'", "'Screenshot_'yyyyMMdd-HHmmss'.png'")]
    names += [F.date_format(at, "'v'yyyy_MM_dd_HH_mm_ss'.mp4'"), F.date_format(at, "'trip-'yyyyMMdd'.heic'"), F.lit("DSC_0042.JPG")]
    return f.select("id", dates.filename_time(F.element_at(F.array(*names), (F.col("id") % 6 + 1).cast("int"))).alias("t"))


_SHOTS = f"{BASE}, p AS (SELECT id, CAST((id * 31 + r.x * 7 + r.y * 13 + c.c * 5) % 256 AS INT) AS v, r.x, r.y, c.c FROM live, (SELECT x, y FROM range(8) a(x), range(8) b(y)) r, range(3) c(c))"


def _shots(spark, d) -> DataFrame:
    """A picture of 8 x 8 pixels for each live file, as 192 bytes."""
    f = files(spark, d).where("trashed_at is null").select("id")
    pixel = lambda k: (F.col("id") * 31 + (F.floor(k / 3) % 8) * 7 + F.floor(k / 24) * 13 + (k % 3) * 5) % 256
    return f.select("id", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(191)), lambda k: F.lpad(F.hex(pixel(k)), 2, "0")), "")).alias("rgb"))


@query("h1_histogram", f"""{_SHOTS}, n AS (SELECT id, c, v, count(*) AS n FROM p GROUP BY id, c, v), px AS (SELECT id, x, y, max(v) AS hi, min(v) AS lo FROM p GROUP BY id, x, y),
s AS (SELECT id, round(count(*) FILTER (hi <= 2) / 64, 6) AS shadows, round(count(*) FILTER (lo >= 253) / 64, 6) AS lights FROM px GROUP BY id)
SELECT n.id, greatest(1, max(n) FILTER (v BETWEEN 1 AND 254)) AS peak, any_value(shadows) AS shadows, any_value(lights) AS lights FROM n JOIN s USING (id) GROUP BY n.id""")
def histogram(spark, d):
    """Histograms of small pictures: the highest count, and the shares of clipped shadows and lights."""
    h = _shots(spark, d).select("id", content.histogram_of(F.col("rgb")).alias("h"))
    return h.select("id", F.col("h.peak").alias("peak"), F.round("h.shadows", 6).alias("shadows"), F.round("h.lights", 6).alias("lights"))


@query("e13_alike_pairs", """WITH r AS (SELECT DISTINCT hash FROM phash_rows WHERE hash IS NOT NULL AND width > 0 AND height > 0), p AS (SELECT DISTINCT hash_a, hash_b FROM phash_pairs WHERE hash_a IS NOT NULL AND hash_b IS NOT NULL)
SELECT hash_a, hash_b, bit_count(hash_a) // 16 = bit_count(hash_b) // 16 AS alike FROM p""")
def alike_pairs(spark, d):
    """Whether the pictures of compared hashes are alike, by their signatures; shades lie further apart than the limit."""
    from silverfold.plans.culling import picture_signature

    p = table(spark, d, "phash_pairs").where("hash_a is not null and hash_b is not null").select("hash_a", "hash_b").distinct()
    return p.select("hash_a", "hash_b", content.alike_of(picture_signature(F.col("hash_a")), picture_signature(F.col("hash_b"))).alias("alike"))


@query("v03_pooled", """WITH e AS (SELECT label, vec_id, embedding FROM embeddings), x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM e, range(1, 65) t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(v * v)) AS l FROM x GROUP BY label)
SELECT label, CAST(i AS INT) AS i, round(v / l, 6) AS v FROM x JOIN n USING (label)""")
def pooled(spark, d):
    """Vectors of a label pooled to one of length 1."""
    p = vectors.mean_vectors(table(spark, d, "embeddings").select("label", "embedding"), "label")
    return p.select("label", F.posexplode("vector").alias("i", "v")).select("label", (F.col("i") + 1).alias("i"), F.round("v", 6).alias("v"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


@query("s12_cities", "SELECT lat, lon, name, cc, population FROM (SELECT DISTINCT lat, lon, name, cc, population FROM geo_cities) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND name IS NOT NULL AND name <> ''")
def cities_text(spark, d):
    """The cities written as tab-separated text, among comments and broken rows, and read back."""
    at = _folder(spark)
    c_ = table(spark, d, "geo_cities").select("lat", "lon", "name", "cc", "population").distinct()
    line = F.concat_ws("\t", F.col("lat").cast("string"), F.col("lon").cast("string"), F.coalesce("name", F.lit("")), F.coalesce("cc", F.lit("")), F.lit("a"), F.lit("b"), F.lit("c"), F.coalesce(F.col("population").cast("string"), F.lit("")), F.lit("k"))
    noise = spark.createDataFrame([("# a comment",), ("broken\trow",), ("95.0\t10.0\tToo far north\tXX\ta\tb\tc\t1\tk",)], "line string")
    c_.select(line.alias("line")).unionByName(noise).write.text(at)
    return media.cities(spark, at).select("lat", "lon", "name", "cc", "population")


@query("s13_regions", "SELECT code, name, level, parent_code, len(polys) AS polygons, bbox[1] AS west FROM (SELECT DISTINCT * FROM geo_regions) WHERE code IS NOT NULL")
def regions_json(spark, d):
    """The regions written as one JSON array and read back."""
    at = _folder(spark)
    r = table(spark, d, "geo_regions").select("code", "name", "level", "parent_code", "bbox", "polys").distinct()
    # a fixed table of about a hundred rows makes one document
    r.agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]")).alias("line")).write.text(at)
    return media.regions(spark, at).select("code", "name", "level", "parent_code", F.size("polys").alias("polygons"), F.col("bbox")[0].alias("west"))


@query("s15_restore", "SELECT id, name, area + 1 AS area FROM libraries")
def restore_newest(spark, d):
    """Three snapshots of the libraries, of which two are kept and the newest is restored."""
    at = _folder(spark)
    lib = table(spark, d, "libraries").select("id", "name", "area")
    for v in ("100", "200", "300"):
        media.snapshot(lib.withColumn("area", F.col("area") + (1 if v == "300" else 9)), at, v)
    media.prune_snapshots(spark, at, 2)
    return media.restore(spark, at)


@query("s17_transfers", f"{BASE} SELECT id, id % 1000 AS sent, size AS bytes, CAST(id % 101 AS INT) AS percent FROM live WHERE size IS NOT NULL")
def transfers(spark, d):
    """What a transfer prints, read back: its statistics and a line of progress."""
    f = files(spark, d, "size").where("trashed_at is null and size is not null").select("id", "size")
    stats = F.format_string("Number of files: 1,234 (reg: 1,200)\nNumber of regular files transferred: %s\nTotal transferred file size: %s bytes\n", F.format_number(F.col("id") % 1000, 0), F.format_number("size", 0))
    progress = F.format_string("  %s  %d%%   10.55MB/s    0:00:12", F.format_number("size", 0), F.col("id") % 101)
    got = f.select("id", media.transfer_stats(stats).alias("s"), media.transfer_progress(progress).alias("p"))
    return got.select("id", "s.sent", "s.bytes", "p.percent")


@query("s10_container_times", f"{BASE} SELECT id, CASE WHEN id % 7 <> 0 THEN taken_at END AS t FROM live WHERE taken_at IS NOT NULL")
def container_times(spark, d):
    """Times of videos out of their containers, of both header versions, behind other boxes; every seventh has none."""
    f = files(spark, d, "taken_at").where("trashed_at is null and taken_at is not null")
    at = F.when(F.col("id") % 7 == 0, F.lit(0)).otherwise(F.col("taken_at") + media.CONTAINER_EPOCH)
    be = lambda x, n: F.lpad(F.hex(x.cast("long")), 2 * n, "0")
    short = F.concat(F.lit("0000001C6D766864" "00000000"), be(at, 4), F.lit("00000000" "000003E8" "00000000"))
    long = F.concat(F.lit("000000286D766864" "01000000"), be(at, 8), F.lit("0000000000000000" "000003E8" "0000000000000000"))
    mvhd = F.when(F.col("id") % 2 == 0, short).otherwise(long)
    moov = F.concat(be(F.length(mvhd) / 2 + 8 + 8, 4), F.lit("6D6F6F76" "0000000866726565"), mvhd)
    data = F.concat(F.lit("0000001066747970" "6D70343200000000" "00000001" "6D646174" "0000000000000014" "00112233"), moov)
    return f.select("id", media.container_time(F.unhex(data)).alias("t"))


@query("s09_exif", f"{BASE} SELECT id, cam_model AS model, CAST(100 * (1 + id % 64) AS BIGINT) AS iso, round(CASE WHEN {_GPS} THEN floor(abs(gps_lat)) * sign(gps_lat) END, 6) AS lat, round(CASE WHEN {_GPS} THEN floor(abs(gps_lon)) * sign(gps_lon) END, 6) AS lon FROM live WHERE length(cam_model) > 3 AND regexp_full_match(cam_model, '[ -~]+') AND trim(cam_model) = cam_model")
def exif(spark, d):
    """Camera, ISO and whole degrees of pictures, written into EXIF blocks of either byte order and read back."""
    f = files(spark, d, "cam_model", "gps_lat", "gps_lon").where("trashed_at is null and length(cam_model) > 3 and cam_model rlike '^[ -~]+$' and trim(cam_model) = cam_model")
    little = F.col("id") % 2 == 0
    turn = lambda h, n: F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(h, i * 2 + 1, F.lit(2)))), "")

    def num(x, n):
        h = F.lpad(F.hex(F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")), 2 * n, "0")
        return F.when(little, turn(h, n)).otherwise(h)

    entry = lambda tag, kind, n, value: F.concat(num(tag, 2), num(kind, 2), num(n, 4), value)
    model = F.concat(F.hex(F.encode("cam_model", "UTF-8")), F.lit("00"))
    size = F.length(model) / 2
    gps = F.expr(_GPS)
    # header 8, main directory 2 + 3 * 12 + 4, sub directory 2 + 12 + 4, positions 2 + 4 * 12 + 4, then the longer values
    sub_at, gps_at, values = 50, 68, 122
    degrees = lambda c: F.concat(num(F.floor(F.abs(F.coalesce(c, F.lit(0.0)))), 4), num(1, 4), num(0, 4), num(1, 4), num(0, 4), num(1, 4))
    ref = lambda c, a, b: F.concat(F.when(F.col(c) < 0, F.lit(b)).otherwise(F.lit(a)), F.lit("000000"))
    main = F.concat(num(3, 2), entry(0x0110, 2, size, num(values + 48, 4)), entry(media.EXIF_SUB, 4, 1, num(sub_at, 4)), entry(media.EXIF_GPS_AT, 4, 1, F.when(gps, num(gps_at, 4)).otherwise(num(0, 4))), num(0, 4))
    sub = F.concat(num(1, 2), entry(0x8827, 3, 1, F.concat(num(100 * (1 + F.col("id") % 64), 2), F.lit("0000"))), num(0, 4))
    pos = F.concat(num(4, 2), entry(1, 2, 2, ref("gps_lat", "4E", "53")), entry(2, 5, 3, num(values, 4)), entry(3, 2, 2, ref("gps_lon", "45", "57")), entry(4, 5, 3, num(values + 24, 4)), num(0, 4))
    tiff = F.concat(F.when(little, "49492A0008000000").otherwise("4D4D002A00000008"), main, sub, pos, degrees(F.col("gps_lat")), degrees(F.col("gps_lon")), model)
    data = F.concat(F.lit("FFD8" "FFE00004ABCD" "FFE1"), F.lpad(F.hex((F.length(tiff) / 2 + 8).cast("long")), 4, "0"), F.lit("457869660000"), tiff, F.lit("FFDA0002FFD9"))
    got = f.select("id", media.exif_of(F.unhex(data)).alias("e"))
    return got.select("id", "e.model", "e.iso", F.round("e.lat", 6).alias("lat"), F.round("e.lon", 6).alias("lon"))


@query("e07_picture_hashes", f"{BASE} SELECT id, sha256(unhex('FFD8FFDB0004AAAAFFDA' || lpad(hex(size % 65536), 4, '0') || 'FFD9')) AS hash FROM live WHERE size IS NOT NULL")
def picture_hashes(spark, d):
    """Hashes of what of a JPEG is picture: application data and comments, which differ from file to file, don't count."""
    f = files(spark, d, "size").where("trashed_at is null and size is not null")
    note = F.hex(F.encode(F.concat(F.lit("note "), F.col("id").cast("string")), "UTF-8"))
    segment = F.concat(F.lpad(F.hex((F.length(note) / 2 + 2).cast("long")), 4, "0"), note)
    data = F.concat(F.lit("FFD8FFE1"), segment, F.lit("FFDB0004AAAA" "FFFE"), segment, F.lit("FFDA"), F.lpad(F.hex(F.col("size") % 65536), 4, "0"), F.lit("FFD9"))
    return f.select("id", content.picture_hash_of(F.unhex(data)).alias("hash"))


@query("e11_phashes", f"""{BASE}, s AS (SELECT DISTINCT id % 50 AS k FROM live), r AS (SELECT CAST(unnest(range(32)) AS INT) AS v), o AS (SELECT CAST(unnest(range(8)) AS INT) AS v),
w AS (SELECT o.v AS u, r.v AS x, cos(pi() * (2 * r.v + 1) * o.v / 64) AS c FROM o, r),
g AS (SELECT k, a.v AS y, b.v AS x, (k * k * 7 + a.v * a.v * 3 + b.v * (k + 11) + a.v * b.v * 5 + (a.v * b.v * k) % 17 * 9) % 256 AS p FROM s, r a, r b),
h AS (SELECT k, w.u, g.y, sum(w.c * p) AS q FROM g JOIN w ON w.x = g.x GROUP BY k, w.u, g.y), c AS (SELECT k, w.u AS row_, h.u AS col_, sum(w.c * q) AS v FROM h JOIN w ON w.x = h.y GROUP BY k, w.u, h.u),
m AS (SELECT k, median(v) AS m FROM c GROUP BY k), b AS (SELECT k, string_agg(CASE WHEN v > m THEN '1' ELSE '0' END, '' ORDER BY row_, col_) AS bits FROM c JOIN m USING (k) GROUP BY k)
SELECT id, bits FROM live JOIN b ON k = id % 50""")
def phashes(spark, d):
    """Perceptual hashes of gray pictures of 32 x 32, one of fifty for each live file, as 64 bits in text."""
    f = files(spark, d).where("trashed_at is null").select("id", (F.col("id") % 50).alias("k"))
    y, x = (lambda i: F.floor(i / 32)), (lambda i: i % 32)
    p = lambda i: (F.col("k") * F.col("k") * 7 + y(i) * y(i) * 3 + x(i) * (F.col("k") + 11) + y(i) * x(i) * 5 + (y(i) * x(i) * F.col("k")) % 17 * 9) % 256
    gray = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.lpad(F.hex(p(i)), 2, "0")), ""))
    shots = f.select("k").distinct().select("k", content.perceptual_hash_of(gray).alias("h"))
    return f.join(F.broadcast(shots), "k").select("id", F.lpad(F.bin("h"), 64, "0").alias("bits"))  # fifty rows


@query("v05_faces", """WITH e AS (SELECT event_id, user_id AS pic, event_id % 97 AS x, user_id % 89 AS y, (event_id * 7 % 50) / 50.0 AS s FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY pic ORDER BY s DESC, event_id) AS r FROM e WHERE s >= 0.8)
SELECT pic, count(*) AS candidates, max(s) AS best FROM b GROUP BY pic""")
def faces(spark, d):
    """Detections of pictures, one of an event each: what scores high enough, and the best, which always stays."""
    e = table(spark, d, "events")
    s = (F.col("event_id") * 7 % 50) / 50
    boxes = e.select(F.col("user_id").alias("pic"), "event_id", (F.col("event_id") % 97).cast("double").alias("x"), (F.col("user_id") % 89).cast("double").alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"), s.alias("cls"), s.alias("obj"))
    kept = vectors.faces_of(boxes, "pic").groupBy("pic").agg(F.max("score").alias("best"))
    n = boxes.where("sqrt(cls * obj) >= 0.8").groupBy("pic").agg(F.count(F.lit(1)).alias("candidates"))
    return n.join(kept, "pic")


@query("e01_confirmed", f"""{BASE}, m AS (SELECT live.*, fo.area, sha256(quick_hash || '/' || coalesce(width, 0)) AS full_hash FROM live JOIN fo ON fo.id = live.folder_id WHERE size > 0 AND quick_hash IS NOT NULL AND right(fo.volume_uuid, 1) <> '1'),
r AS (SELECT *, row_number() OVER (PARTITION BY size, full_hash ORDER BY culling_flag <> 1, area NOT IN (1, 2), taken_at NULLS LAST, id) AS k FROM m)
SELECT size, full_hash, count(*) AS n, max(CASE WHEN k = 1 THEN id END) AS best_id, CAST(size * (count(*) - 1) AS BIGINT) AS gain, bool_and(culling_flag > 0) AND count(*) FILTER (culling_flag = 1) = 1 AS closed FROM r GROUP BY size, full_hash HAVING count(*) > 1""")
def confirmed(spark, d):
    """Duplicates confirmed by a full hash, here of the quick one and the width; volumes that end in 1 are away."""
    fo = folders(spark, d, "area", "volume_uuid").withColumnRenamed("id", "folder_id")
    m = files(spark, d, "folder_id", "size", "quick_hash", "width", "culling_flag", "taken_at").where("trashed_at is null").join(fo, "folder_id")
    full = F.sha2(F.concat_ws("/", "quick_hash", F.coalesce("width", F.lit(0)).cast("string")), 256)
    return cull.confirmed_groups(m, "quick_hash", full, F.substring("volume_uuid", -1, 1) != "1").withColumnRenamed("full", "full_hash")


@query("t01_taken_at_names", """WITH f AS (SELECT DISTINCT id, taken_at, modified_at, created_at FROM files), n AS (SELECT 1800000000 AS now),
p AS (SELECT id, CASE WHEN taken_at BETWEEN 946598400 AND now + 86400 THEN taken_at END AS e, CASE WHEN id % 3 = 0 AND modified_at BETWEEN 1000000000 AND 1780000000 THEN modified_at - 86400 END AS s,
  CASE WHEN modified_at BETWEEN 946598400 AND now + 86400 THEN modified_at END AS m, CASE WHEN created_at BETWEEN 946598400 AND now + 86400 THEN created_at END AS c, now FROM f, n)
SELECT id, coalesce(e, s, least(m, c), now) AS taken_at, CASE WHEN e IS NOT NULL THEN 0 WHEN s IS NOT NULL THEN 1 WHEN m IS NOT NULL OR c IS NOT NULL THEN 2 ELSE 3 END AS source FROM p""")
def taken_names(spark, d):
    """The time of each file with its source; every third has a name that tells the day before it was changed."""
    f = table(spark, d, "files").select("id", "taken_at", "modified_at", "created_at").distinct()
    tells = (F.col("id") % 3 == 0) & F.col("modified_at").between(1000000000, 1780000000)
    name = F.when(tells, F.date_format(F.timestamp_seconds(F.col("modified_at") - 86400), "'IMG_'yyyyMMdd_HHmmss'.jpg'")).otherwise(F.lit("DSC_0042.JPG"))
    x = dates.taken_at(F.col("taken_at"), dates.filename_time(name), F.col("modified_at"), F.col("created_at"), 1800000000)
    return f.select("id", x.alias("x")).select("id", "x.taken_at", "x.source")


@query("s08_prune_folders", f"{BASE} SELECT folder_id, id FROM live WHERE folder_id % 2 = 0 AND id % 13 = 0")
def prune_folders(spark, d):
    """Half of the folders scanned again, where every thirteenth file is gone."""
    f = files(spark, d, "folder_id").where("trashed_at is null")
    return ledger.prune_folders(f, f.where("id % 13 <> 0"), f.where("folder_id % 2 = 0"), "id", "folder_id")


@query("q29_recent_batches", f"""{BASE}, j AS (SELECT folder_id AS batch_id, id AS file_id, id % 4 <> 0 AS ok FROM f WHERE folder_id IS NOT NULL),
b AS (SELECT batch_id, CASE batch_id % 3 WHEN 0 THEN 'trash' WHEN 1 THEN 'restore' ELSE 'move' END AS kind, CASE WHEN batch_id % 5 = 0 THEN 0 ELSE count(*) END AS item_count, batch_id % 11 = 0 AS undone FROM j GROUP BY batch_id),
n AS (SELECT batch_id, count(*) AS good, count(*) FILTER (trashed_at IS NOT NULL) AS gone, count(*) FILTER (trashed_at IS NULL) AS live FROM j JOIN f ON f.id = file_id WHERE ok GROUP BY batch_id),
r AS (SELECT b.batch_id, kind, CASE WHEN item_count = 0 AND NOT undone THEN coalesce(good, 0) ELSE item_count END AS item_count,
  undone OR (item_count > 0 AND ((kind = 'trash' AND coalesce(gone, 0) = 0) OR (kind = 'restore' AND coalesce(live, 0) = 0))) AS undone FROM b LEFT JOIN n USING (batch_id) WHERE b.batch_id % 7 <> 0)
SELECT * FROM r WHERE item_count > 0 ORDER BY batch_id DESC LIMIT 50""")
def recent_batches(spark, d):
    """The newest batches, one a folder; every fifth was left open, every seventh belongs to another."""
    f = files(spark, d, "folder_id")
    j = f.where("folder_id is not null").select(F.col("folder_id").alias("batch_id"), F.col("id").alias("file_id"), (F.col("id") % 4 != 0).alias("ok"))
    kind = F.element_at(F.array(F.lit("trash"), F.lit("restore"), F.lit("move")), (F.col("batch_id") % 3 + 1).cast("int"))
    b = j.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).select("batch_id", kind.alias("kind"), F.when(F.col("batch_id") % 5 == 0, 0).otherwise(F.col("n")).alias("item_count"), (F.col("batch_id") % 11 == 0).alias("undone"))
    return ledger.recent_batches(b, j, f, b.where("batch_id % 7 = 0"), 50)


@query("e25_done_side", """WITH r AS (SELECT DISTINCT row_id, pair_id, side FROM tree_files), p AS (SELECT pair_id, count(*) FILTER (side = 'a') AS files_a, count(*) FILTER (side = 'b') AS files_b,
  count(*) FILTER (side = 'a' AND (pair_id % 3 = 0 OR row_id % 2 = 0)) AS flagged_a, count(*) FILTER (side = 'b' AND pair_id % 3 = 1) AS flagged_b FROM r GROUP BY pair_id)
SELECT pair_id, CASE WHEN pair_id % 4 = 3 THEN NULL WHEN files_a > 0 AND flagged_a >= files_a THEN 'a' WHEN files_b > 0 AND flagged_b >= files_b THEN 'b' END AS side FROM p""")
def done_side(spark, d):
    """Pairs of which one side is marked to go already; every fourth pair shares nothing that could be dropped."""
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side").distinct()
    a, b = F.col("side") == "a", F.col("side") == "b"
    n = r.groupBy("pair_id").agg(F.count_if(a).alias("files_a"), F.count_if(b).alias("files_b"), F.count_if(a & ((F.col("pair_id") % 3 == 0) | (F.col("row_id") % 2 == 0))).alias("flagged_a"), F.count_if(b & (F.col("pair_id") % 3 == 1)).alias("flagged_b"))
    k = F.col("pair_id") % 4
    return n.select("pair_id", trees.done_side(k == 0, k == 1, k == 2, *(F.col(c) for c in ("files_a", "files_b", "flagged_a", "flagged_b"))).alias("side"))


_FAMILY = f"""{BASE.replace("WITH f AS", "WITH RECURSIVE f AS")}, m AS (SELECT live.id, live.size, live.culling_flag, live.taken_at, fo.area, lower(live.cam_model) AS cam, live.width, live.height, live.kind, live.quick_hash, CASE WHEN quick_hash IS NOT NULL AND live.id % 10 <> 9 THEN sha256(quick_hash || '/' || live.size) END AS full_hash
  FROM live JOIN fo ON fo.id = live.folder_id WHERE live.size > 0),
x AS (SELECT id, full_hash AS k FROM m WHERE full_hash IS NOT NULL),
t AS (SELECT id, 'i' || cam || width || '/' || size // 65536 AS k FROM m WHERE kind = 0 AND EXISTS (SELECT 1 FROM m y WHERE y.kind = 0 AND y.cam = m.cam AND y.width = m.width AND y.height = m.height AND y.size <> m.size AND abs(y.size - m.size) <= 65536)),
l AS (SELECT min(id) OVER (PARTITION BY k) AS a, id AS b FROM x UNION SELECT min(id) OVER (PARTITION BY k) AS a, id AS b FROM t),
u AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b), w AS (SELECT DISTINCT a AS v, a AS far FROM u UNION SELECT w.v, u.b FROM w JOIN u ON u.a = w.far),
r AS (SELECT v AS id, min(far) AS family FROM w GROUP BY v), p AS (SELECT m.*, family, row_number() OVER (PARTITION BY family ORDER BY culling_flag <> 1, area NOT IN (1, 2), taken_at NULLS LAST, id) AS k FROM m JOIN r USING (id))"""


@query("e04_families", f"""{_FAMILY} SELECT family, count(*) AS n, max(CASE WHEN k = 1 THEN id END) AS best_id, CAST(sum(size) - max(CASE WHEN k = 1 THEN size END) AS BIGINT) AS gain, bool_and(culling_flag > 0) AND count(*) FILTER (culling_flag = 1) = 1 AS closed,
CASE WHEN count(full_hash) = count(*) AND min(full_hash) = max(full_hash) THEN 'exact' ELSE 'metadata' END AS reason FROM p GROUP BY family""")
def duplicate_families(spark, d):
    """Equal files and files that differ in their metadata alone, merged to families; camera and width stand for the picture, and every tenth file has not been read in full."""
    fo = folders(spark, d, "area").withColumnRenamed("id", "folder_id")
    m = files(spark, d, "folder_id", "size", "quick_hash", "width", "height", "kind", "cam_model", "culling_flag", "taken_at").where("trashed_at is null and size > 0").join(fo, "folder_id")
    full = F.when(F.col("quick_hash").isNotNull() & (F.col("id") % 10 != 9), F.unhex(F.sha2(F.concat_ws("/", "quick_hash", F.col("size").cast("string")), 256)))
    # read by three steps, so it is written once
    m = Stages(spark, "families").save(m.select("id", "size", "area", "culling_flag", "taken_at", "kind", "width", "height", F.lower("cam_model").alias("cam"), full.alias("full_hash")))
    image = F.concat(F.lit("i"), "cam", F.col("width").cast("string"), F.lit("/"), F.floor(F.col("size") / 65536).cast("string"))
    twins = cull.twin_groups(m.where("kind = 0 and cam is not null and width is not null and height is not null"), ["cam", "width", "height"], "size", 65536, image)
    return cull.duplicate_families(m, [(m.where("full_hash is not null"), ["full_hash"]), (twins, ["image"])], "full_hash")
