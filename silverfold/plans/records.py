"""Queries over names, times, state and plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from silverfold.functions import content, dates, names
from silverfold.operators import ledger, naming
from silverfold.plans.browse import BASE, GPS, files, folders
from silverfold.plans.registry import query
from silverfold.sources import media
from silverfold.session import table

_PARSED = f"""{BASE}, p AS (SELECT id, library_id, name, CASE WHEN regexp_matches(name, '^(\\d{{4}})([-._])(\\d{{2}})([-._])(\\d{{2}})') AND substr(name, 5, 1) = substr(name, 8, 1) THEN substr(name, 1, 4) || '-' || substr(name, 6, 2) || '-' || substr(name, 9, 2)
  WHEN regexp_matches(name, '^\\d{{8}}') THEN substr(name, 1, 4) || '-' || substr(name, 5, 2) || '-' || substr(name, 7, 2) END AS date,
  CASE WHEN regexp_matches(name, '^(\\d{{4}})([-._])(\\d{{2}})([-._])(\\d{{2}})') AND substr(name, 5, 1) = substr(name, 8, 1) THEN trim(ltrim(substr(name, 11), ' _-.~'), ' ')
  WHEN regexp_matches(name, '^\\d{{8}}') THEN trim(ltrim(substr(name, 9), ' _-.~'), ' ') ELSE trim(name, ' ') END AS title FROM fo)"""


def _parsed(spark, d, *cols):
    return folders(spark, d, "name", *cols).select("*", names.parse_folder(F.col("name")).alias("p")).select("id", "name", *cols, "p.date", "p.title")


@query("n01_folder_names", f"{_PARSED} SELECT id, date, title FROM p")
def folder_names(spark, d):
    return _parsed(spark, d).select("id", "date", "title")


@query("n02_next_day", f"""{_PARSED} SELECT id, title || ' ' || (id % 7) || '일차' AS title, CASE WHEN title = '' THEN ' ' || (id % 7) || '일차' ELSE rtrim(title, ' ') || ' ' || (id % 7 + 1) || '일차' END AS next FROM p""")
def next_day(spark, d):
    t = F.concat("title", F.lit(" "), (F.col("id") % 7).cast("string"), F.lit(names.DAY_MARK))
    return _parsed(spark, d).select("id", t.alias("title")).select("id", "title", names.next_day(F.col("title")).alias("next"))


_WORDS = f"""{_PARSED}, w AS (SELECT id, date, unnest(list_filter(regexp_split_to_array(title, '[\\s\\-_,()]+'), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$') AND NOT ends_with(x, '일차'))) AS word FROM p)"""


@query("n03_words", f"{_WORDS} SELECT word, count(*) AS n FROM w GROUP BY word")
def words(spark, d):
    return _parsed(spark, d).select(F.explode(names.words(F.col("title"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("n04_suggest", f"""{_WORDS}, g AS (SELECT folder_id, strftime(make_timestamp(min(taken_at) * 1000000), '%Y-%m-%d') AS day, avg(gps_lat) FILTER ({GPS}) AS lat, avg(gps_lon) FILTER ({GPS}) AS lon FROM live GROUP BY folder_id),
k AS (SELECT g.*, p.date, p.title FROM g JOIN p ON p.id = g.folder_id), s AS (SELECT folder_id AS sel, day, lat, lon FROM k WHERE day IS NOT NULL),
c AS (SELECT sel, title, 100 AS score FROM s JOIN k ON substr(k.date, 6) = substr(s.day, 6) WHERE title <> '' AND k.date <> s.day
  UNION ALL SELECT sel, CASE WHEN regexp_matches(title, '[0-9]일차$') THEN regexp_replace(title, '[0-9]+일차$', '') || (CAST(regexp_extract(title, '([0-9]+)일차$', 1) AS INT) + 1) || '일차' ELSE title || ' 2일차' END, 120 FROM s JOIN k ON try_cast(k.date AS DATE) = CAST(s.day AS DATE) - 1 WHERE title <> ''
  UNION ALL SELECT sel, title, 90 - CAST(trunc(km * 10) AS INT) FROM (SELECT sel, title, 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(k.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - s.lon) / 2), 2)))) AS km FROM s, k WHERE title <> '') WHERE km < 3
  UNION ALL SELECT sel, word, 10 FROM s, (SELECT word, count(*) AS n FROM w WHERE date IS NOT NULL AND id IN (SELECT folder_id FROM g) GROUP BY word HAVING count(*) >= 3 ORDER BY n DESC, word LIMIT 8)),
b AS (SELECT sel, title, max(score) AS score FROM c GROUP BY sel, title), r AS (SELECT *, row_number() OVER (PARTITION BY sel ORDER BY score DESC, title) AS r FROM b)
SELECT sel, title, score FROM r WHERE r <= 5""")
def suggest(spark, d):
    """Five names for the pictures of each folder in use: yesterday's, other years', nearby ones, frequent words."""
    from silverfold.operators.catalog import valid_gps

    at = lambda c: F.avg(F.when(valid_gps(), F.col(c)))
    g = files(spark, d, "folder_id", "taken_at", "gps_lat", "gps_lon").where("trashed_at is null").groupBy("folder_id").agg(F.date_format(F.timestamp_seconds(F.min("taken_at")), "yyyy-MM-dd").alias("day"), at("gps_lat").alias("lat"), at("gps_lon").alias("lon"))
    k = g.join(_parsed(spark, d).select(F.col("id").alias("folder_id"), "date", "title"), "folder_id")
    return naming.suggest(k.where("day is not null").select(F.col("folder_id").alias("sel"), "day", "lat", "lon"), k)


@query("n05_audit", f"""{_PARSED}, m AS (SELECT folder_id, strftime(make_timestamp(min(taken_at) * 1000000), '%Y-%m-%d') AS day FROM live WHERE taken_at IS NOT NULL GROUP BY folder_id),
a AS (SELECT p.id, p.library_id, p.name, m.day || CASE WHEN title = '' THEN '' ELSE ' ' || title END AS proposed FROM p JOIN m ON m.folder_id = p.id WHERE p.date IS NULL)
SELECT id, proposed, count(*) OVER (PARTITION BY library_id, proposed) > 1 AS conflict FROM a""")
def audit(spark, d):
    """Undated folders with the name they should have, after their earliest picture; conflict where two would be one."""
    m = files(spark, d, "folder_id", "taken_at").where("trashed_at is null and taken_at is not null").groupBy(F.col("folder_id").alias("id")).agg(F.date_format(F.timestamp_seconds(F.min("taken_at")), "yyyy-MM-dd").alias("day"))
    a = _parsed(spark, d, "library_id").where("date is null").join(m, "id")
    a = a.select("id", "library_id", F.concat_ws(" ", "day", F.nullif("title", F.lit(""))).alias("proposed"))
    n = F.count(F.lit(1)).over(Window.partitionBy("library_id", "proposed"))
    return a.select("id", "proposed", (n > 1).alias("conflict"))


_EVENTS = f"""{BASE}, e AS (SELECT live.id, fo.library_id, live.taken_at AS t, live.taken_at // 86400 AS day FROM live JOIN fo ON fo.id = live.folder_id JOIN libraries l ON l.id = fo.library_id WHERE l.area = 0 AND live.taken_at IS NOT NULL),
m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {{gap}} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY library_id, day ORDER BY t, id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY library_id, day ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS no FROM m),
c AS (SELECT library_id, day, no, min(t) AS start_at, max(t) AS end_at, count(*) AS n FROM s GROUP BY library_id, day, no HAVING count(*) >= {{least}})"""


def _desk(spark, d):
    """Live timed files of desk libraries."""
    desk = table(spark, d, "libraries").where("area = 0").select(F.col("id").alias("library_id"))
    fo = folders(spark, d, "library_id").join(desk, "library_id").select(F.col("id").alias("folder_id"), "library_id")
    return files(spark, d, "folder_id", "taken_at").where("trashed_at is null and taken_at is not null").join(fo, "folder_id").select("library_id", "id", "taken_at")


@query("n06_event_candidates", _EVENTS.format(gap=10800, least=5) + " SELECT library_id, library_id || ':' || start_at || ':' || end_at AS cand_key, start_at, end_at, n FROM c")
def candidates(spark, d):
    """Events of desk libraries: three hours' quiet or a new day ends one, five pictures make one."""
    return naming.event_candidates(_desk(spark, d), 180, 5).select("library_id", "cand_key", "start_at", "end_at", "n")


@query("n06_event_items", _EVENTS.format(gap=1800, least=2) + " SELECT s.library_id || ':' || start_at || ':' || end_at AS cand_key, id, row_number() OVER (PARTITION BY s.library_id, s.day, s.no ORDER BY t, id) AS seq FROM s JOIN c USING (library_id, day, no)")
def items(spark, d):
    """The pictures of events under the least pause and number that may be asked for."""
    f = _desk(spark, d)
    return naming.event_items(f, naming.event_candidates(f, 1, 1))


@query("n07_event_dirs", f"{_PARSED} SELECT p.id, CASE WHEN fo.area = 1 THEN x ELSE substr(date, 1, 4) || '/' || x END AS dir FROM (SELECT *, date || CASE WHEN title = '' THEN '' ELSE ' ' || trim(translate(title, '/\\:', '---'), ' ') END AS x FROM p WHERE date IS NOT NULL) p JOIN fo ON fo.id = p.id")
def event_dirs(spark, d):
    return _parsed(spark, d, "area").where("date is not null").select("id", names.event_dir(F.col("date"), F.nullif("title", F.lit("")), F.col("area")).alias("dir"))


@query("t01_taken_at", """WITH f AS (SELECT DISTINCT id, taken_at, modified_at, created_at FROM files), n AS (SELECT 1800000000 AS now),
p AS (SELECT id, CASE WHEN taken_at BETWEEN 946598400 AND now + 86400 THEN taken_at END AS e, CASE WHEN modified_at BETWEEN 946598400 AND now + 86400 THEN modified_at END AS m, CASE WHEN created_at BETWEEN 946598400 AND now + 86400 THEN created_at END AS c, now FROM f, n)
SELECT id, coalesce(e, least(m, c), now) AS taken_at, CASE WHEN e IS NOT NULL THEN 0 WHEN m IS NOT NULL OR c IS NOT NULL THEN 2 ELSE 3 END AS source FROM p""")
def taken(spark, d):
    """The time of each file with the source it came from, without the names' share."""
    f = table(spark, d, "files").select("id", "taken_at", "modified_at", "created_at").distinct()
    x = dates.taken_at(F.col("taken_at"), F.lit(None).cast("long"), F.col("modified_at"), F.col("created_at"), 1800000000)
    return f.select("id", x.alias("x")).select("id", "x.taken_at", "x.source")


@query("t02_video_time", """WITH f AS (SELECT DISTINCT id, taken_at AS a, created_at AS b, modified_at AS c FROM files WHERE kind = 1),
v AS (SELECT id, unnest([{'at': a, 'clue': 0}, {'at': b, 'clue': 1}, {'at': c, 'clue': 2}]) AS x FROM f) SELECT id, min(x.at) AS taken_at, arg_min(x.clue, (x.at, x.clue)) AS clue FROM v WHERE x.at BETWEEN 946598400 AND 1800086400 GROUP BY id""")
def video_time(spark, d):
    f = table(spark, d, "files").where("kind = 1").select("id", "taken_at", "created_at", "modified_at").distinct()
    x = dates.video_taken_at([F.col("taken_at"), F.col("created_at"), F.col("modified_at")], 1800000000)
    return f.select("id", x.alias("x")).where("x is not null").select("id", F.col("x.at").alias("taken_at"), F.col("x.clue").alias("clue"))


@query("t05_exif_time", "WITH f AS (SELECT DISTINCT id, taken_at FROM files WHERE taken_at BETWEEN 946684800 AND 1798761599) SELECT id, taken_at AS t FROM f")
def exif_time(spark, d):
    """Times written as EXIF does and read back."""
    f = files(spark, d, "taken_at").where("taken_at is not null")
    return f.select("id", dates.exif_time(F.date_format(F.timestamp_seconds("taken_at"), "yyyy:MM:dd HH:mm:ss")).alias("t"))


@query("t06_date_audit", f"{BASE} SELECT id, CASE WHEN taken_at_source = 0 THEN 'embedded' WHEN taken_at_source = 1 THEN 'filename' ELSE 'none' END AS found, taken_at_source = 1 AND taken_at IS NOT NULL AS selected FROM live")
def date_audit(spark, d):
    s = F.col("taken_at_source")
    return files(spark, d, "taken_at", "taken_at_source").where("trashed_at is null").select("id", F.when(s == 0, "embedded").when(s == 1, "filename").otherwise("none").alias("found"), ((s == 1) & F.col("taken_at").isNotNull()).alias("selected"))


def _free_sql(taken: str, wanted: str, out: str) -> str:
    """SQL of free names, by trying every number: ``t`` holds taken names, ``w`` wanted ones (id, folder_id, name)."""
    return f"""{BASE}, t AS ({taken}), w AS ({wanted}), names AS (SELECT folder_id, lower(name) AS l FROM w UNION SELECT folder_id, lower(name) FROM t),
p AS (SELECT *, lower(name) AS l, CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^(.+)\\.([^.]+)$', 1) ELSE name END AS stem,
  CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN '.' || regexp_extract(name, '^(.+)\\.([^.]+)$', 2) ELSE '' END AS ext FROM w),
r AS (SELECT p.*, row_number() OVER (PARTITION BY folder_id, l ORDER BY id) - CASE WHEN (folder_id, l) IN (SELECT (folder_id, lower(name)) FROM t) THEN 0 ELSE 1 END AS n FROM p),
g AS (SELECT folder_id, l, any_value(lower(stem)) AS stem, any_value(lower(ext)) AS ext, max(n) AS most FROM r GROUP BY folder_id, l HAVING max(n) > 0),
c AS (SELECT folder_id, l, k, stem || ' (' || k || ')' || ext AS cand FROM (SELECT *, unnest(range(2, 2 + most + (SELECT count(*) FROM names x WHERE x.folder_id = g.folder_id AND contains(x.l, '(')))) AS k FROM g)),
u AS (SELECT folder_id, l, k, row_number() OVER (PARTITION BY folder_id, l ORDER BY k) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM names x WHERE x.folder_id = c.folder_id AND x.l = c.cand)),
d AS (SELECT r.*, CASE WHEN r.n <= 0 THEN r.name ELSE r.stem || ' (' || u.k || ')' || r.ext END AS free_name FROM r LEFT JOIN u ON u.folder_id = r.folder_id AND u.l = r.l AND u.n = r.n) {out}"""


@query("l01_mark", f"{BASE} SELECT id, CASE WHEN id % 3 = 0 THEN 5 ELSE rating END AS rating, CASE WHEN id % 3 = 0 THEN 0 ELSE culling_flag END AS culling_flag, favorite FROM f")
def mark(spark, d):
    """Every third file is given a rating out of range and a flag below it."""
    f = files(spark, d, "rating", "culling_flag", "favorite").drop("trashed_at")
    c = f.where("id % 3 = 0").select("id", F.lit(9).alias("rating"), F.lit(-4).alias("culling_flag"), F.lit(None).cast("boolean").alias("favorite"))
    return ledger.mark(f, c)


@query("l03_undo", f"""{BASE}, j AS (SELECT id, folder_id AS batch_id, name || '#' || id AS from_path, name || '@' || id AS to_path, size, modified_at FROM f),
n AS (SELECT to_path AS path, size + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS size, modified_at FROM j WHERE id % 7 <> 0)
SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY id DESC) AS seq, j.to_path AS from_path, j.from_path AS to_path, CASE WHEN n.path IS NULL THEN 'missing' WHEN n.size = j.size THEN 'move' ELSE 'skip' END AS action FROM j LEFT JOIN n ON n.path = j.to_path""")
def undo(spark, d):
    """Undoing a move of every file, by folder; some are gone or changed since."""
    f = files(spark, d, "folder_id", "name", "size", "modified_at")
    j = f.select("id", F.col("folder_id").alias("batch_id"), F.concat("name", F.lit("#"), F.col("id").cast("string")).alias("from_path"), F.concat("name", F.lit("@"), F.col("id").cast("string")).alias("to_path"), "size", "modified_at", F.lit(None).cast("long").alias("undone_at"))
    now = j.where("id % 7 <> 0").select(F.col("to_path").alias("path"), (F.col("size") + (F.col("id") % 5 == 0).cast("int")).alias("size"), "modified_at")
    return ledger.undo_plan(j, now)


@query("l04_transfer", f"""{BASE}, p AS (SELECT f.id, f.folder_id, f.name, f.quick_hash AS hash, fo.area FROM f JOIN fo ON fo.id = f.folder_id WHERE f.rating >= 3),
t AS (SELECT DISTINCT folder_id, lower(name) AS l FROM f WHERE rating < 3), d AS (SELECT DISTINCT quick_hash AS hash FROM f WHERE favorite AND quick_hash IS NOT NULL),
k AS (SELECT p.*, row_number() OVER (PARTITION BY folder_id, lower(name) ORDER BY id) > 1 AS again FROM p)
SELECT id, name, CASE WHEN hash IN (FROM d) THEN 'skip_published' WHEN again OR EXISTS (SELECT 1 FROM t WHERE t.folder_id = k.folder_id AND t.l = lower(k.name)) THEN 'rename' WHEN area = 1 THEN 'copy' ELSE 'move' END AS action FROM k""")
def transfer(spark, d):
    """Moving the better rated files to a shared area in folders where the others lie already."""
    f = files(spark, d, "folder_id", "name", "quick_hash", "rating", "favorite")
    fo = folders(spark, d, "area").select(F.col("id").alias("folder_id"), F.col("area").alias("from_area"))
    picks = f.where("rating >= 3").join(fo, "folder_id").select("id", "folder_id", "name", F.col("quick_hash").alias("hash"), "from_area", F.lit(2).alias("to_area"))
    return ledger.transfer_plan(picks, f.where("rating < 3").select("folder_id", "name"), f.where("favorite and quick_hash is not null").select(F.col("quick_hash").alias("hash")), rename=True)


@query("l05_sync", """WITH r AS (SELECT DISTINCT side, pair_id, nfc_normalize(CASE WHEN coalesce(sub, '') = '' THEN name ELSE sub || '/' || name END) AS path, size, modified_at FROM tree_files), r2 AS (SELECT * FROM r WHERE NOT ends_with(path, '.mp4')),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.path, b.path) AS path, a.size AS s, a.modified_at AS sm, b.size AS t, b.modified_at AS tm FROM (FROM r2 WHERE side = 'a') a FULL JOIN (FROM r2 WHERE side = 'b') b ON a.pair_id = b.pair_id AND a.path = b.path),
x AS (SELECT pair_id, path, CASE WHEN tm IS NULL THEN 'new' WHEN sm IS NULL THEN 'orphan' WHEN tm > sm + 2 THEN 'conflict' WHEN s <> t THEN 'size_changed' WHEN sm > tm + 2 THEN 'modified' END AS action FROM j) SELECT * FROM x WHERE action IS NOT NULL""")
def sync(spark, d):
    """What brings side b of each pair in line with side a, but for videos."""
    from silverfold.operators.diff import nfc

    r = table(spark, d, "tree_files")
    path = F.when(F.coalesce(F.col("sub"), F.lit("")) == "", F.col("name")).otherwise(F.concat("sub", F.lit("/"), "name"))
    r = r.select("side", "pair_id", nfc(path).alias("path"), "size", "modified_at").distinct()
    return ledger.sync_plan(r.where("side = 'a'"), r.where("side = 'b'"), ["pair_id", "path"], ["*.mp4"])


@query("l06_verify", f"""{BASE}, a AS (SELECT DISTINCT library_id, live.id FROM live JOIN fo ON fo.id = live.folder_id WHERE library_id IS NOT NULL),
b AS (SELECT *, id % CASE WHEN library_id % 3 = 0 THEN 4 ELSE 11 END <> 0 AS there FROM a),
n AS (SELECT library_id, count(*) AS expected, count(*) FILTER (there) AS present FROM b GROUP BY library_id)
SELECT library_id, id, NOT present * 10 < expected * 9 AS allowed FROM b JOIN n USING (library_id) WHERE NOT there""")
def verify(spark, d):
    """Files of each library another store no longer lists, and whether the store holds enough of the library to believe it."""
    fo = folders(spark, d, "library_id").select(F.col("id").alias("folder_id"), "library_id")
    a = files(spark, d, "folder_id").where("trashed_at is null").join(fo, "folder_id").select("library_id", "id")
    present = a.where("id % if(library_id % 3 = 0, 4, 11) <> 0")
    return ledger.verify(a, present, "id", "library_id")


@query("l07_purge", f"{BASE} SELECT id, CASE WHEN NOT (scanned_at > trashed_at) THEN 'pending' WHEN culling_flag = 2 THEN 'discarded' WHEN quick_hash IS NOT NULL THEN 'uploaded' ELSE 'unknown' END AS class FROM f WHERE trashed_at IS NOT NULL")
def purge(spark, d):
    """What trashed files are; a hash stands for an upload, a later scan for a finished one."""
    f = files(spark, d, "culling_flag", "quick_hash", "scanned_at").where("trashed_at is not null")
    return f.select("id", ledger.purge_class(F.col("culling_flag"), F.col("quick_hash").isNotNull(), F.col("scanned_at") > F.col("trashed_at")).alias("class"))


@query("l07_latest", "SELECT hash_a, arg_max(pair_id, (compared_at, pair_id)) AS pair_id, max(compared_at) AS compared_at FROM phash_pairs WHERE hash_a IS NOT NULL GROUP BY hash_a")
def latest(spark, d):
    """The latest comparison of each hash."""
    j = table(spark, d, "phash_pairs").where("hash_a is not null").select("hash_a", "compared_at", "pair_id")
    return ledger.latest(j, "hash_a", "compared_at").select("hash_a", "pair_id", "compared_at")


#: The trashed file of an id beside the live ones: every third bears a number that is thereby taken.
_TAKEN = "SELECT folder_id, CASE WHEN id % 3 = 0 THEN regexp_replace(name, '^(.+)\\.([^.]+)$', '\\1 (2).\\2') ELSE name END AS name FROM f WHERE trashed_at IS NOT NULL"


@query("l09_free_names", _free_sql(_TAKEN, "SELECT id, folder_id, name FROM live UNION ALL SELECT -id, folder_id, name FROM live WHERE id % 5 = 0", "SELECT id, free_name FROM d"))
def free_names(spark, d):
    """Names of the live files of each folder, every fifth twice, were they to lie beside the trashed, some of which are numbered."""
    f = files(spark, d, "folder_id", "name")
    live, gone = f.where("trashed_at is null").select("id", "folder_id", "name"), f.where("trashed_at is not null")
    taken = gone.select("folder_id", F.when(F.col("id") % 3 == 0, F.regexp_replace("name", r"^(.+)\.([^.]+)$", "$1 (2).$2")).otherwise(F.col("name")).alias("name"))
    wanted = live.unionByName(live.where("id % 5 = 0").withColumn("id", -F.col("id")))
    return ledger.free_names(wanted, taken, "folder_id", "name", "id").select("id", "free_name")


@query("l10_cache_keys")
def cache_keys(spark, d):
    """Keys of the cache, over path, size and time."""
    f = files(spark, d, "name", "size", "modified_at")
    return f.select("id", content.cache_key_of(F.col("name"), F.col("size"), F.coalesce("modified_at", F.lit(0).cast("long"))).alias("key"))


@query("s02_kinds", f"""{BASE}, e AS (SELECT id, name, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS x FROM f) SELECT id, CASE WHEN starts_with(name, '.') THEN NULL
  WHEN x IN ('{"', '".join(names.RAW)}') THEN 2 WHEN x IN ('{"', '".join(names.IMAGE)}') THEN 0 WHEN x IN ('{"', '".join(names.VIDEO)}') THEN 1 END AS kind FROM e""")
def kinds(spark, d):
    return files(spark, d, "name").select("id", names.kind_of(F.col("name")).alias("kind"))


@query("s04_changed", f"""{BASE} SELECT id FROM f WHERE id % 4 = 0 OR (kind = 1 AND duration_ms IS NULL)""")
def changed(spark, d):
    """Files a rescan has to read again: every fourth has grown, and videos without a length."""
    known = files(spark, d, "folder_id", "name", "size", "modified_at", "kind", "duration_ms")
    seen = known.select("id", F.col("folder_id"), "name", (F.col("size") + (F.col("id") % 4 == 0).cast("int")).alias("size"), "modified_at")
    return ledger.changed_files(seen, known, ["id"]).select("id")


@query("s05_merge", f"""{BASE} SELECT id, size + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN id % 4 <> 0 THEN quick_hash END AS quick_hash, CASE WHEN id % 9 <> 0 OR gps_lat IS NULL THEN cam_model END AS cam_model FROM f""")
def merge(spark, d):
    """The table after a rescan; hashes of changed files are gone, as are places of moved ones."""
    known = files(spark, d, "size", "modified_at", "gps_lat", "gps_lon", "quick_hash", "cam_model")
    scan = known.select("id", (F.col("size") + (F.col("id") % 4 == 0).cast("int")).alias("size"), "modified_at", (F.col("gps_lat") + (F.col("id") % 9 == 0).cast("int")).alias("gps_lat"), "gps_lon")
    return ledger.merge_scan(known, scan, "id", ["quick_hash"], ["cam_model"]).select("id", "size", "quick_hash", "cam_model")


@query("s06_overrides", f"{BASE} SELECT id, CASE WHEN id % 6 = 0 THEN 1000000000 + id ELSE taken_at END AS taken_at, CASE WHEN id % 6 = 0 THEN 4 ELSE taken_at_source END AS source FROM f")
def overrides(spark, d):
    """Dates set by hand win over those of a scan."""
    f = files(spark, d, "taken_at", "taken_at_source")
    o = f.where("id % 6 = 0").select("id", (F.col("id") + 1000000000).alias("by_hand"))
    return f.join(o, "id", "left").select("id", F.coalesce("by_hand", "taken_at").alias("taken_at"), F.when(F.col("by_hand").isNotNull(), dates.MANUAL).otherwise(F.col("taken_at_source")).alias("source"))


@query("s11_pending_thumbs", f"{BASE} SELECT id FROM live WHERE id % 3 <> 0 OR id % 5 = 0")
def pending(spark, d):
    """Live files without a thumbnail of their present size."""
    f = files(spark, d, "size")
    done = f.where("id % 3 = 0").select(F.col("id").alias("file_id"), (F.col("id") % 5 != 0).alias("fresh"))
    return ledger.pending_work(f, done, F.lit(True), F.col("fresh")).select("id")


@query("s14_sidecars", f"""{BASE} SELECT id, name, CASE WHEN culling_flag = 2 THEN -1 ELSE rating END AS rating FROM live WHERE rating > 0 OR culling_flag > 0 OR favorite""")
def sidecars(spark, d):
    """Files that get a sidecar, and the rating it states."""
    s = media.sidecars(files(spark, d, "name", "rating", "culling_flag", "favorite").where("trashed_at is null"))
    return s.select("id", "name", F.regexp_extract("xmp", 'xmp:Rating="(-?[0-9]+)"', 1).cast("int").alias("rating"))


@query("s18_import", f"""{BASE}, k AS (SELECT DISTINCT name, size, quick_hash FROM f WHERE id % 2 = 0), c AS (SELECT name || '/' || id AS path, name, size, quick_hash, taken_at FROM f)
SELECT path, strftime(make_timestamp(taken_at * 1000000), '%Y-%m-%d') AS day, size, EXISTS (SELECT 1 FROM k WHERE k.name = c.name AND k.size = c.size AND (k.quick_hash IS NULL OR c.quick_hash IS NULL OR k.quick_hash = c.quick_hash)) AS is_dup FROM c""")
def import_look(spark, d):
    """All files offered for import to a library that has every second one."""
    return _look(spark, d)


def _look(spark, d):
    f = files(spark, d, "name", "size", "quick_hash", "taken_at")
    found = f.select(F.concat("name", F.lit("/"), F.col("id").cast("string")).alias("path"), "name", "size", F.col("quick_hash").alias("hash"), "taken_at")
    return ledger.import_look(found, f.where("id % 2 = 0").select("name", "size", F.col("quick_hash").alias("hash")))


@query("s19_preview", f"""{BASE}, k AS (SELECT DISTINCT name, size, quick_hash FROM f WHERE id % 2 = 0),
c AS (SELECT size, strftime(make_timestamp(taken_at * 1000000), '%Y-%m-%d') AS day, EXISTS (SELECT 1 FROM k WHERE k.name = f.name AND k.size = f.size AND (k.quick_hash IS NULL OR f.quick_hash IS NULL OR k.quick_hash = f.quick_hash)) AS is_dup FROM f)
SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (is_dup) AS dups, (SELECT string_agg(day, ',' ORDER BY day) FROM (SELECT DISTINCT day FROM c WHERE day IS NOT NULL ORDER BY day LIMIT 8)) AS days FROM c""")
def import_preview(spark, d):
    return ledger.import_preview(_look(spark, d)).withColumn("days", F.array_join("days", ","))


@query("s20_city_names", "WITH n AS (SELECT admin1_name AS k, name, city_id % 4 = 0 AS pref FROM geo_cities WHERE admin1_name IS NOT NULL) SELECT k, arg_min(name, (NOT pref, length(name), name)) AS name FROM n GROUP BY k")
def city_names(spark, d):
    n = table(spark, d, "geo_cities").where("admin1_name is not null").select(F.col("admin1_name").alias("k"), "name", (F.col("city_id") % 4 == 0).alias("preferred"))
    return media.preferred_names(n, "k")


@query("q29_recent_runs", "WITH r AS (SELECT DISTINCT * FROM phash_runs) SELECT run_id, max(reported_at) AS at, count(*) AS reports, bool_or(phase = 'done') AS closed FROM r GROUP BY run_id")
def recent(spark, d):
    """Runs, newest first, and whether they came to an end."""
    r = table(spark, d, "phash_runs").distinct()
    return r.groupBy("run_id").agg(F.max("reported_at").alias("at"), F.count(F.lit(1)).alias("reports"), F.bool_or(F.col("phase") == "done").alias("closed")).orderBy(F.desc("at"))


@query("l02_journal", f"{BASE}, m AS (SELECT id, size, modified_at, row_number() OVER (ORDER BY id) AS seq FROM f WHERE folder_id = 12) SELECT 7 AS batch_id, seq, id, size FROM m")
def journal(spark, d):
    """The journal of moving one folder's files."""
    f = files(spark, d, "folder_id", "name", "size", "modified_at").where("folder_id = 12")
    m = f.select("id", F.col("name").alias("from_path"), F.concat(F.lit("new/"), F.col("name")).alias("to_path"), "size", "modified_at")
    return ledger.journal_rows(m, 7, 1_700_000_000).select("batch_id", "seq", "id", "size")


@query("l02_journal_folders", f"{BASE} SELECT folder_id AS batch_id, row_number() OVER (PARTITION BY folder_id ORDER BY id) AS seq, id, size FROM f WHERE folder_id IS NOT NULL")
def journal_folders(spark, d):
    """The journal of moving every folder's files, a batch a folder."""
    f = files(spark, d, "folder_id", "name", "size", "modified_at").where("folder_id is not null")
    m = f.select("id", "folder_id", F.col("name").alias("from_path"), F.concat(F.lit("new/"), F.col("name")).alias("to_path"), "size", "modified_at")
    return ledger.journal_rows(m, "folder_id", 1_700_000_000).select("batch_id", "seq", "id", "size")


@query("l02_batches", "WITH p AS (SELECT DISTINCT * FROM phash_pairs), b AS (SELECT DISTINCT run_id AS batch_id FROM phash_runs) SELECT b.batch_id, count(p.pair_id) AS steps, count(p.pair_id) FILTER (p.alike IS NULL) > 0 AS can_undo FROM b LEFT JOIN p ON p.run_id = b.batch_id GROUP BY b.batch_id")
def batches(spark, d):
    """Batches with their steps; comparisons without a result stand for steps still to undo."""
    b = table(spark, d, "phash_runs").select(F.col("run_id").alias("batch_id"), F.lit(0).cast("long").alias("started_at")).distinct()
    j = table(spark, d, "phash_pairs").select("pair_id", F.col("run_id").alias("batch_id"), "alike").distinct().select("batch_id", F.when(F.col("alike").isNotNull(), 1).alias("undone_at"))
    return ledger.close_batches(b, j).drop("started_at")


@query("l08_trash_plan", f"{BASE} SELECT id, folder_id || '/' || name AS from_path, '.trash/' || id || '/' || name AS to_path, 1700000000 AS trashed_at FROM live WHERE culling_flag = 2")
def trash_plan(spark, d):
    return ledger.trash_plan(files(spark, d, "folder_id", "name", "culling_flag"), 1_700_000_000)


@query("l08_restore_plan", _free_sql("SELECT folder_id, name FROM live", "SELECT id, folder_id, name FROM f WHERE trashed_at IS NOT NULL", "SELECT id, folder_id, free_name FROM d"))
def restore_plan(spark, d):
    return ledger.restore_plan(files(spark, d, "folder_id", "name"))


@query("l08_rename_plan", _free_sql("SELECT folder_id, name FROM live WHERE taken_at IS NULL", "SELECT id, folder_id, name AS old, strftime(make_timestamp(taken_at * 1000000), '%Y%m%d') || '.' || lower(ext) AS name FROM live WHERE taken_at IS NOT NULL", "SELECT id, old, free_name FROM d WHERE free_name <> old"))
def rename_plan(spark, d):
    """Files named after their day, made free within their folder."""
    live = files(spark, d, "folder_id", "name", "ext", "taken_at").where("trashed_at is null")
    pattern = F.concat(F.date_format(F.timestamp_seconds("taken_at"), "yyyyMMdd"), F.lit("."), F.lower("ext"))
    return ledger.rename_plan(live.where("taken_at is not null"), pattern, live)


@query("l08_merge_plan", """WITH r AS (SELECT DISTINCT row_id AS id, pair_id, side, name, full_hash AS hash FROM tree_files WHERE pair_id = 10), b AS (SELECT * FROM r WHERE side = 'b')
SELECT id, CASE WHEN hash IN (SELECT hash FROM b WHERE hash IS NOT NULL) THEN 'drop' WHEN lower(name) IN (SELECT lower(name) FROM b) THEN 'rename' ELSE 'move' END AS action FROM r WHERE side = 'a'""")
def merge_plan(spark, d):
    """Merging side a of one pair into side b."""
    r = table(spark, d, "tree_files").where("pair_id = 10").select(F.col("row_id").alias("id"), "side", "name", F.col("full_hash").alias("hash")).distinct()
    return ledger.merge_plan(r.where("side = 'a'"), r.where("side = 'b'"))


@query("l08_merge_plan_pairs", """WITH r AS (SELECT DISTINCT row_id AS id, pair_id, side, name, full_hash AS hash FROM tree_files), b AS (SELECT * FROM r WHERE side = 'b')
SELECT pair_id, id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.pair_id = r.pair_id AND b.hash = r.hash) THEN 'drop' WHEN EXISTS (SELECT 1 FROM b WHERE b.pair_id = r.pair_id AND lower(b.name) = lower(r.name)) THEN 'rename' ELSE 'move' END AS action FROM r WHERE side = 'a'""")
def merge_plan_pairs(spark, d):
    """Merging side a of every pair into its side b."""
    r = table(spark, d, "tree_files").select("pair_id", F.col("row_id").alias("id"), "side", "name", F.col("full_hash").alias("hash")).distinct()
    return ledger.merge_plan(r.where("side = 'a'"), r.where("side = 'b'"), ["pair_id"])


@query("l11_common_dir", f"""{BASE}, p AS (SELECT volume_uuid, string_split(min(rel_path), '/') AS a, string_split(max(rel_path), '/') AS b FROM fo WHERE rel_path <> '' GROUP BY volume_uuid),
n AS (SELECT volume_uuid, a, list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]) AS d, least(len(a), len(b)) AS m FROM p)
SELECT volume_uuid, array_to_string(a[1:CASE WHEN len(d) > 0 THEN d[1] - 1 ELSE m END], '/') AS dir FROM n""")
def common_dirs(spark, d):
    """The folder all paths of a volume have in common: that of the first and the last path in order."""
    p = folders(spark, d, "volume_uuid", "rel_path").where("rel_path <> ''").groupBy("volume_uuid").agg(F.array(F.min("rel_path"), F.max("rel_path")).alias("p"))
    return p.select("volume_uuid", names.common_dir(F.col("p")).alias("dir"))


@query("s03_skipped", f"{BASE} SELECT id, list_has_any(string_split(rel_path, '/'), ['{"', '".join(names.SKIPPED)}']) OR len(list_filter(string_split(rel_path, '/'), lambda x: starts_with(x, '.git'))) > 0 AS skipped FROM fo")
def skipped(spark, d):
    return folders(spark, d, "rel_path").select("id", names.skipped(F.col("rel_path")).alias("skipped"))


@query("s07_prune", f"{BASE}, b AS (SELECT id FROM live WHERE folder_id % 3 <> 0), g AS (SELECT id FROM live WHERE folder_id % 3 = 0) SELECT id, (SELECT count(*) FROM b) > 0 AND NOT ((SELECT count(*) FROM live) >= 100 AND (SELECT count(*) FROM g) > 0.5 * (SELECT count(*) FROM live)) AS allowed FROM g")
def prune(spark, d):
    """Files of folders a scan no longer saw, and whether they may be dropped."""
    live = files(spark, d, "folder_id").where("trashed_at is null")
    return ledger.missing(live.select("id"), live.where("folder_id % 3 <> 0").select("id"), "id")


@query("s16_settings", "SELECT id AS key, CASE WHEN id % 10 = 0 THEN 'changed' ELSE name END AS value FROM libraries")
def settings(spark, d):
    """A keyed table after changes."""
    t = table(spark, d, "libraries").select(F.col("id").alias("key"), F.col("name").alias("value"))
    return ledger.put(t, t.where("key % 10 = 0").withColumn("value", F.lit("changed")), "key")


@query("t04_plausible", f"WITH f AS (SELECT DISTINCT id, taken_at FROM files) SELECT id, coalesce(taken_at BETWEEN 946598400 AND 1800086400, false) AS plausible FROM f")
def plausible(spark, d):
    f = table(spark, d, "files").select("id", "taken_at").distinct()
    return f.select("id", dates.plausible(F.col("taken_at"), 1800000000).alias("plausible"))


@query("x_quality", f"{BASE} SELECT id, round(least(coalesce(sharpness, 0) / 200, 1) * 0.45::DOUBLE + 0.0::DOUBLE * 0.30::DOUBLE + least(CAST(coalesce(width, 0) AS DOUBLE) * coalesce(height, 0) / 24000000, 1) * 0.15::DOUBLE + rating / 5 * 0.10::DOUBLE, 9)::DOUBLE AS score FROM live")
def quality(spark, d):
    """A score of sharpness, size and rating; exposure isn't stored."""
    from silverfold.functions.quality import score

    f = files(spark, d, "sharpness", "width", "height", "rating").where("trashed_at is null")
    pixels = F.col("width").cast("double") * F.col("height") / 24_000_000
    return f.select("id", F.round(score(F.col("sharpness") / 200, F.lit(0.0), pixels, F.col("rating") / 5), 9).alias("score"))


@query("x_rules", f"{BASE} SELECT id FROM live WHERE kind = 0 AND size > 1000000 AND contains(lower(name), 'img')")
def rules(spark, d):
    """Files that meet all conditions of a stored rule."""
    from silverfold.operators.catalog import rule

    text = '[{"field": "kind", "op": "eq", "value": 0}, {"field": "size", "op": "gt", "value": 1000000}, {"field": "name", "op": "contains", "value": "IMG"}]'
    return files(spark, d, "kind", "size", "name").where("trashed_at is null").where(rule(text)).select("id")
