"""Entity resolution over the catalogue: duplicates, junk, bursts, near-duplicates, scenes, and what follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverfold.operators import cull
from silverfold.plans.browse import BASE, files, folders
from silverfold.plans.registry import query
from silverfold.session import Stages, table


def _members(spark, d, *cols):
    got = files(spark, d, "folder_id", "size", *cols).where("trashed_at is null")
    return got.join(folders(spark, d, "area").select(F.col("id").alias("folder_id"), "area"), "folder_id")


EXACT = f"""{BASE}, m AS (SELECT live.*, fo.area FROM live JOIN fo ON fo.id = live.folder_id WHERE size > 0 AND quick_hash IS NOT NULL),
g AS (SELECT size, quick_hash, count(*) AS n FROM m GROUP BY size, quick_hash HAVING count(*) > 1),
r AS (SELECT m.*, row_number() OVER (PARTITION BY size, quick_hash ORDER BY culling_flag <> 1, area NOT IN (1, 2), taken_at NULLS LAST, id) AS k FROM m SEMI JOIN g USING (size, quick_hash))"""


@query("e01_exact_duplicates", f"{EXACT} SELECT size, quick_hash, count(*) AS n, max(CASE WHEN k = 1 THEN id END) AS best_id, CAST(size * (count(*) - 1) AS BIGINT) AS gain, bool_and(culling_flag > 0) AND count(*) FILTER (culling_flag = 1) = 1 AS closed FROM r GROUP BY size, quick_hash")
def exact(spark, d):
    return cull.exact_groups(_members(spark, d, "quick_hash", "culling_flag", "taken_at"), "quick_hash")


@query("e01_duplicate_members", f"{EXACT} SELECT id, quick_hash, k = 1 AS is_best FROM r")
def exact_members(spark, d):
    rows = _members(spark, d, "quick_hash", "culling_flag", "taken_at")
    g = cull.exact_groups(rows, "quick_hash").select("size", "quick_hash", "best_id")
    return rows.join(g, ["size", "quick_hash"]).select("id", "quick_hash", (F.col("id") == F.col("best_id")).alias("is_best"))


@query("e01_exact_texts", "SELECT min(doc_id) AS best_id, count(*) AS n FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1")
def exact_texts(spark, d):
    """Equal texts, by length first and then by SHA-256, so only candidates are hashed and moved."""
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "text", F.length("text").alias("len"))
    return cull.staged_groups(docs, "len", F.sha2("text", 256), "doc_id").select("best_id", "n")


TWINS = f"""{BASE}, p AS (SELECT p_partkey AS id, p_brand, p_type, p_size, p_retailprice AS size FROM part),
t AS (SELECT x.id, x.p_brand, x.p_type, x.p_size FROM p x WHERE EXISTS (SELECT 1 FROM p y WHERE y.p_brand = x.p_brand AND y.p_type = x.p_type AND y.p_size = x.p_size AND y.size <> x.size AND abs(y.size - x.size) <= 50))"""


@query("e02_twins", f"{TWINS} SELECT * FROM t")
def twins(spark, d):
    """Rows alike in name but of slightly different size."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("size"))
    return cull.twins(p, ["p_brand", "p_type", "p_size"], "size", 50.0).select("id", "p_brand", "p_type", "p_size")


JUNK = f"""{BASE}, l AS (SELECT id AS library_id, rel_path AS root FROM libraries),
j AS (SELECT live.id, live.size, live.width, lower(live.name) AS n, lower(CASE WHEN starts_with(fo.rel_path, l.root || '/') THEN substr(fo.rel_path, length(l.root) + 2) ELSE fo.rel_path END) AS dir
  FROM live JOIN fo ON fo.id = live.folder_id LEFT JOIN l USING (library_id)),
c AS (SELECT id, size, CASE WHEN starts_with(n, 'screenshot') OR starts_with(n, 'screen shot') OR starts_with(n, '스크린샷') OR contains(dir, 'screenshot') OR contains(dir, '스크린샷') THEN 'screenshot'
  WHEN starts_with(n, 'kakaotalk') OR contains(dir, 'kakaotalk') THEN 'messenger'
  WHEN list_has_any(string_split(dir, '/'), ['download', 'downloads', '다운로드']) THEN 'downloaded'
  WHEN size > 0 AND size < 61440 AND (width IS NULL OR width <= 400) THEN 'too_small' END AS reason FROM j)"""


@query("e08_junk", f"{JUNK} SELECT id, reason FROM c WHERE reason IS NOT NULL")
def junk(spark, d):
    fo = folders(spark, d, "rel_path", "library_id").select(F.col("id").alias("folder_id"), "rel_path", "library_id")
    lib = table(spark, d, "libraries").select(F.col("id").alias("library_id"), F.col("rel_path").alias("root"))
    inside = F.when(F.startswith("rel_path", F.concat("root", F.lit("/"))), F.expr("substr(rel_path, length(root) + 2)")).otherwise(F.col("rel_path"))
    fo = fo.join(lib, "library_id", "left").select("folder_id", inside.alias("dir"))
    rows = files(spark, d, "folder_id", "name", "size", "width").where("trashed_at is null").join(fo, "folder_id")
    return rows.select("id", cull.junk_reason(F.col("name"), F.col("dir"), F.col("size"), F.col("width")).alias("reason")).where("reason is not null")


BURST = f"""{BASE}, b AS (SELECT *, CASE WHEN taken_at - lag(taken_at) OVER (PARTITION BY folder_id ORDER BY taken_at, id) <= 10 THEN 0 ELSE 1 END AS new
  FROM live WHERE kind <> 1 AND taken_at_source <= 1 AND taken_at IS NOT NULL),
i AS (SELECT *, sum(new) OVER (PARTITION BY folder_id ORDER BY taken_at, id ROWS UNBOUNDED PRECEDING) AS no FROM b)"""
_BURST_BEST = "arg_max(id, (sharpness IS NOT NULL, coalesce(sharpness, size), taken_at, id))"


@query("e09_bursts", f"{BURST} SELECT folder_id, min(taken_at) AS start_at, max(taken_at) AS end_at, count(*) AS n, {_BURST_BEST} AS best_id, CAST(sum(size) - max(size) AS BIGINT) AS gain FROM i GROUP BY folder_id, no HAVING count(*) BETWEEN 3 AND 60")
def bursts(spark, d):
    rows = files(spark, d, "folder_id", "size", "kind", "taken_at", "taken_at_source", "sharpness").where("trashed_at is null and kind <> 1 and taken_at_source <= 1 and taken_at is not null")
    return cull.bursts(rows, gap=10)


NEAR = """WITH r AS (SELECT DISTINCT * FROM phash_rows WHERE hash IS NOT NULL AND width > 0 AND height > 0), h AS (SELECT DISTINCT hash FROM r),
c AS (SELECT a.hash AS a, b.hash AS b, bit_count(xor(a.hash, b.hash)) AS d FROM (SELECT hash, k, (hash >> (8 * k)) & 255 AS v FROM h, range(8) t(k)) a JOIN (SELECT hash, k, (hash >> (8 * k)) & 255 AS v FROM h, range(8) t(k)) b USING (k, v) WHERE a.hash < b.hash)"""


@query("e14_near_pairs", f"{NEAR} SELECT DISTINCT a, b, CAST(d AS INT) AS distance FROM c WHERE d <= 4")
def near_pairs(spark, d):
    """Pairs of different 64-bit hashes at most 4 bits apart."""
    return cull.hamming_pairs(table(spark, d, "phash_rows").where("hash is not null and width > 0 and height > 0"), "hash", 4)


def _lesser_copies(spark, d):
    """Copies other than the best of the exact groups that are still open."""
    # written once, as the groups and their members are read from it
    rows = Stages(spark, "copies").save(_members(spark, d, "quick_hash", "culling_flag", "taken_at"))
    g = cull.exact_groups(rows, "quick_hash").where("not closed").select("size", "quick_hash", "best_id")
    return rows.select("id", "size", "quick_hash").join(g, ["size", "quick_hash"]).where("id <> best_id").select(F.col("id").alias("file_id"))


def picture_signature(hash_col):
    """A flat picture, one of five shades by the bits of the hash, as the tables hold no pictures."""
    shade = F.lpad(F.hex(F.floor(F.bit_count(hash_col) / 16) * 40), 2, "0")
    return F.unhex(F.concat(F.lit("01"), F.repeat(shade, 384)))


@query("e14_near_groups")
def near_groups(spark, d):
    """Near-duplicate groups: candidates by keys of several blocks, links where the pictures are alike, clusters around the largest."""
    rows = table(spark, d, "phash_rows").distinct().withColumn("signature", picture_signature(F.col("hash")))
    return cull.near_groups(rows, 4, signature="signature", skip=_lesser_copies(spark, d))


@query("e18_scenes")
def scenes(spark, d):
    """Scenes of alike pictures within an hour; a file's vector is that of its number among the first 500, and open exact groups stay as they are."""
    f = files(spark, d, "folder_id", "size", "kind", "taken_at", "sharpness", "quick_hash", "culling_flag").where("trashed_at is null and kind <> 1 and taken_at is not null")
    f = f.join(folders(spark, d, "area").select(F.col("id").alias("folder_id"), "area"), "folder_id")
    e = table(spark, d, "embeddings").where("vec_id < 500").select("vec_id", "embedding")
    rows = f.withColumn("vec_id", F.pmod("id", F.lit(500))).join(e, "vec_id")
    g = cull.exact_groups(f, "quick_hash").where("not closed").select("size", "quick_hash", F.col("best_id").alias("group_id"))
    grouped = f.select("id", "size", "quick_hash").join(g, ["size", "quick_hash"]).select("id", "group_id")
    return cull.scenes(rows, threshold=0.35, grouped=grouped)


GROUPS = """WITH m AS (SELECT DISTINCT * FROM member_rows), n AS (SELECT group_id, count(*) AS n, sum(size) AS size_bytes, count(*) FILTER (is_best) AS bests FROM m GROUP BY group_id)"""


@query("q25_groups", f"{GROUPS}, k AS (SELECT m.*, row_number() OVER (PARTITION BY group_id ORDER BY is_best DESC NULLS LAST, score DESC NULLS LAST, size DESC, file_id) AS r FROM m) SELECT n.group_id, n, CAST(size_bytes AS BIGINT) AS size_bytes, k.name AS cover, k.library FROM n JOIN k ON k.group_id = n.group_id AND r = 1 ORDER BY size_bytes DESC, n.group_id LIMIT 200")
def group_list(spark, d):
    return cull.group_list(table(spark, d, "member_rows").select("group_id", "file_id", "name", "size", "is_best", "score", "library").distinct(), 200)


@query("q26_members", f"{GROUPS} SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY is_best DESC NULLS LAST, score DESC NULLS LAST, size DESC, file_id) AS pos FROM m")
def members(spark, d):
    """Members of each group, best first."""
    return cull.ranked(table(spark, d, "member_rows").select("group_id", "file_id", "size", "is_best", "score").distinct()).select("group_id", "file_id", "pos")


@query("q27_groups_by_library", "SELECT library_id, count(DISTINCT group_id) AS n FROM member_rows WHERE library_id IS NOT NULL GROUP BY library_id")
def groups_by_library(spark, d):
    return table(spark, d, "member_rows").where("library_id is not null").groupBy("library_id").agg(F.countDistinct("group_id").alias("n"))


_STATE = "CASE WHEN bool_and(culling_flag > 0) THEN 'done' ELSE 'open' END"


@query("q28_cull_summary", f"WITH m AS (SELECT DISTINCT * FROM member_rows), g AS (SELECT group_id, {_STATE} AS state, count(*) AS n, sum(size) AS b FROM m GROUP BY group_id) SELECT state, count(*) AS groups, CAST(sum(n) AS BIGINT) AS photos, CAST(sum(b) AS BIGINT) AS bytes FROM g GROUP BY state")
def cull_summary(spark, d):
    m = table(spark, d, "member_rows").select("group_id", "file_id", "culling_flag", "size").distinct()
    g = m.groupBy("group_id").agg(F.when(F.bool_and(F.col("culling_flag") > 0), "done").otherwise("open").alias("state"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    return g.groupBy("state").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("photos"), F.sum("b").alias("bytes"))


APPLY = f"""{GROUPS}, b AS (SELECT group_id, arg_min(file_id, (coalesce(area, 0) NOT IN (1, 2), -size, file_id)) AS best_id FROM m GROUP BY group_id)"""


@query("e26_apply", f"{APPLY} SELECT m.group_id, m.file_id, m.culling_flag AS old_flag, CASE WHEN m.file_id = b.best_id THEN 1 ELSE 2 END AS new_flag FROM m JOIN b USING (group_id) WHERE m.culling_flag <> CASE WHEN m.file_id = b.best_id THEN 1 ELSE 2 END")
def apply_groups(spark, d):
    """Which flags change when every group keeps its best: the best 1, the others 2."""
    m = table(spark, d, "member_rows").select("group_id", "file_id", "size", "area", "culling_flag").distinct()
    return cull.apply_groups(m, skip_settled=False)


@query("e27_apply_all", f"{APPLY}, s AS (SELECT group_id FROM m JOIN b USING (group_id) WHERE file_id <> best_id AND area IN (1, 2)) SELECT m.group_id, m.file_id, m.culling_flag AS old_flag, CASE WHEN m.file_id = b.best_id THEN 1 ELSE 2 END AS new_flag FROM m JOIN b USING (group_id) WHERE m.group_id NOT IN (FROM s) AND m.culling_flag <> CASE WHEN m.file_id = b.best_id THEN 1 ELSE 2 END AND NOT (m.culling_flag = 1 AND m.file_id <> b.best_id)")
def apply_all(spark, d):
    """As e26, but groups that would drop a settled file are left alone and kept files stay kept."""
    m = table(spark, d, "member_rows").select("group_id", "file_id", "size", "area", "culling_flag").distinct()
    return cull.apply_groups(m, skip_settled=True)


@query("e26_unapply", "WITH m AS (SELECT DISTINCT * FROM member_rows) SELECT group_id, file_id, culling_flag AS old_flag, 0 AS new_flag FROM m WHERE culling_flag <> 0")
def unapply(spark, d):
    m = table(spark, d, "member_rows").select("group_id", "file_id", "culling_flag").distinct()
    return m.where("culling_flag <> 0").select("group_id", "file_id", F.col("culling_flag").alias("old_flag"), F.lit(0).alias("new_flag"))


@query("e29_set_best", "WITH m AS (SELECT DISTINCT group_id, file_id FROM member_rows), w(group_id, file_id) AS (SELECT group_id, max(file_id) FROM m GROUP BY group_id) SELECT m.group_id, m.file_id, w.file_id IS NOT NULL AS is_best FROM m LEFT JOIN w USING (group_id, file_id)")
def set_best(spark, d):
    """A chosen member becomes the best of its group; a choice that is no member changes nothing."""
    m = table(spark, d, "member_rows").select("group_id", "file_id").distinct()
    return cull.set_best(m, m.groupBy("group_id").agg(F.max("file_id").alias("file_id")))


@query("e03_families", f"""{TWINS}, d AS (SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.id < y.id WHERE abs(x.size - y.size) <= 50),
u AS (SELECT a, b FROM d UNION SELECT b, a FROM d), w AS (SELECT DISTINCT a AS v, a AS far FROM u UNION SELECT w.v, u.b FROM w JOIN u ON u.a = w.far) SELECT v, min(far) AS root FROM w GROUP BY v""".replace("WITH f AS", "WITH RECURSIVE f AS"))
def families(spark, d):
    """Links of equal and of slightly different rows merged to families."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_size", F.col("p_retailprice").alias("size"))
    return cull.labels(cull.neighbour_links(p, ["p_brand", "p_type", "p_size"], "size", "id", 50.0))


@query("e05_quick_hashes")
def quick_hashes(spark, d):
    """Quick hashes of the documents' bytes."""
    from silverfold.functions.content import quick_hash_of

    return table(spark, d, "documents").where("text <> ''").select("doc_id", quick_hash_of(F.encode("text", "UTF-8")).alias("hash"))


@query("e06_full_hashes", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text <> ''")
def full_hashes(spark, d):
    return table(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("e13_alike_vectors", "WITH e AS (SELECT vec_id AS id, embedding FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_sum([abs(x) for x in list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE - z[2]::DOUBLE)]) / 64 AS m FROM e a JOIN e b ON b.id = a.id + 1) SELECT a, b, round(m, 6) AS mad FROM p")
def mad(spark, d):
    """Mean absolute differences of neighbouring vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), "embedding")
    n = e.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("embedding").alias("other"))
    diff = F.aggregate(F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size("embedding")
    return e.join(n, "a").select("a", "b", F.round(diff, 6).alias("mad"))
