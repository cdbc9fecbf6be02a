"""Queries over folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverfold.operators import trees as t
from silverfold.operators.diff import nfc
from silverfold.plans.browse import BASE, files, folders
from silverfold.plans.registry import query
from silverfold.session import table

_LEAVES = f"""{BASE}, n AS (SELECT folder_id, count(*) AS n FROM live GROUP BY folder_id),
lv AS (SELECT fo.volume_uuid, fo.id, array_to_string(list_filter(string_split(rel_path, '/'), lambda x: x <> ''), '/') AS path, coalesce(n, 0) AS n FROM fo LEFT JOIN n ON n.folder_id = fo.id WHERE rel_path <> ''),
up AS (SELECT volume_uuid, id, path, n, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM lv),
a AS (SELECT volume_uuid, id, path, n, array_to_string(string_split(path, '/')[1:i], '/') AS a FROM up)"""


def _leaves(spark, d):
    n = files(spark, d, "folder_id").where("trashed_at is null").groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    fo = folders(spark, d, "volume_uuid", "rel_path").join(n.withColumnRenamed("folder_id", "id"), "id", "left")
    return fo.select("volume_uuid", "id", F.col("rel_path").alias("path"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("q16_folder_tree", f"""{_LEAVES} SELECT volume_uuid, a AS path, min(CASE WHEN a = path THEN id END) AS id, list_last(string_split(a, '/')) AS name, len(string_split(a, '/')) - 1 AS depth, CAST(sum(n) AS BIGINT) AS total, max(a <> path) AS has_children
FROM a GROUP BY volume_uuid, a""")
def folder_tree(spark, d):
    return t.folder_tree(_leaves(spark, d), ["volume_uuid"])


@query("q17_library_tree", f"""{_LEAVES}, l AS (SELECT id AS library_id, volume_uuid, rel_path AS root FROM libraries),
g AS (SELECT l.library_id, CASE WHEN a.a = root THEN '#' || l.library_id ELSE '#' || l.library_id || '/' || substr(a.a, length(root) + 2) END AS path, CAST(sum(n) AS BIGINT) AS total FROM a JOIN l USING (volume_uuid)
  WHERE root <> '' AND (a.a = root OR starts_with(a.a, root || '/')) GROUP BY 1, 2)
SELECT library_id, path, total, len(string_split(path, '/')) - 1 AS depth, path = '#' || library_id AS is_library FROM g""")
def library_tree(spark, d):
    """The tree of each library under a node of its own."""
    lib = table(spark, d, "libraries").where("rel_path <> ''").select(F.col("id").alias("library_id"), "volume_uuid", F.col("rel_path").alias("root"))
    node = t.folder_tree(_leaves(spark, d), ["volume_uuid"]).select("volume_uuid", "path", "total").join(lib, "volume_uuid")
    mine = node.where((F.col("path") == F.col("root")) | F.startswith("path", F.concat("root", F.lit("/"))))
    own = F.concat(F.lit("#"), F.col("library_id").cast("string"))
    path = F.when(F.col("path") == F.col("root"), own).otherwise(F.concat(own, F.lit("/"), F.expr("substr(path, length(root) + 2)")))
    got = mine.select("library_id", path.alias("path"), "total")
    return got.select("library_id", "path", "total", (F.size(F.split("path", "/")) - 1).alias("depth"), (F.col("path") == own).alias("is_library"))


@query("q30_folder_size", f"""{_LEAVES}, b AS (SELECT folder_id, count(*) AS n, sum(size) AS bytes FROM live GROUP BY folder_id), x AS (SELECT a.volume_uuid, a.a AS path, a.id, b.n, b.bytes FROM a LEFT JOIN b ON b.folder_id = a.id)
SELECT volume_uuid, path, count(*) AS folders, CAST(coalesce(sum(n), 0) AS BIGINT) AS files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM x GROUP BY volume_uuid, path""")
def folder_size(spark, d):
    """Folders, files and bytes at and below each path."""
    per = files(spark, d, "folder_id", "size").where("trashed_at is null").groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    fo = folders(spark, d, "volume_uuid", "rel_path").where("rel_path <> ''").join(per, "id", "left")
    up = fo.select("volume_uuid", F.explode(t.ancestors(F.col("rel_path"))).alias("path"), "n", "b")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return up.groupBy("volume_uuid", "path").agg(F.count(F.lit(1)).alias("folders"), zero("n").alias("files"), zero("b").alias("bytes"))


@query("q33_husks", f"""{_LEAVES}, liv AS (SELECT DISTINCT volume_uuid, a AS path FROM a WHERE n > 0), e AS (SELECT DISTINCT volume_uuid, path FROM lv ANTI JOIN liv USING (volume_uuid, path)),
top AS (SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM e u WHERE u.volume_uuid = e.volume_uuid AND u.path = regexp_replace(e.path, '/?[^/]*$', '')))
SELECT top.volume_uuid, top.path, count(*) AS n_folders FROM top JOIN e ON e.volume_uuid = top.volume_uuid AND (e.path = top.path OR starts_with(e.path, top.path || '/')) GROUP BY ALL""")
def husks(spark, d):
    """Topmost folders without a live file below."""
    lv = _leaves(spark, d).withColumn("path", F.array_join(F.filter(F.split("path", "/"), lambda x: x != ""), "/"))
    return t.husks(lv, lv, ["volume_uuid"])


@query("n05_dated_names", f"""{BASE}, n AS (SELECT folder_id, count(*) AS n FROM live GROUP BY folder_id), tl AS (SELECT id AS library_id, array_to_string(list_filter(string_split(nfc_normalize(rel_path), '/'), lambda x: x <> ''), '/') AS root FROM libraries),
tf AS (SELECT fo.library_id, array_to_string(list_filter(string_split(nfc_normalize(rel_path), '/'), lambda x: x <> ''), '/') AS full_path, nfc_normalize(name) AS name, coalesce(n, 0) AS n FROM fo LEFT JOIN n ON n.folder_id = fo.id),
b AS (SELECT library_id, CASE WHEN root = '' THEN full_path ELSE substr(full_path, length(root) + 2) END AS path, name, n FROM tf JOIN tl USING (library_id) WHERE root = '' OR starts_with(full_path, root || '/')),
u AS (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM b WHERE path <> ''), a AS (SELECT library_id, array_to_string(string_split(path, '/')[1:i], '/') AS source_dir, path, name, n FROM u),
g AS (SELECT library_id, source_dir, CAST(sum(n) AS BIGINT) AS file_count, list(DISTINCT name) FILTER (source_dir = path) AS own FROM a GROUP BY library_id, source_dir HAVING len(list_filter(string_split(source_dir, '/'), lambda x: starts_with(x, '.') OR x = '@eaDir')) = 0),
e AS (SELECT library_id, source_dir, regexp_replace(source_dir, '/?[^/]*$', '') AS parent_dir, unnest(coalesce(own, [list_last(string_split(source_dir, '/'))])) AS current_name, file_count FROM g),
d AS (SELECT *, CASE WHEN regexp_matches(current_name, '^\\d{{4}}([-._])\\d{{2}}[-._]\\d{{2}}') AND substr(current_name, 5, 1) = substr(current_name, 8, 1) THEN substr(current_name, 1, 4) || '-' || substr(current_name, 6, 2) || '-' || substr(current_name, 9, 2)
  WHEN regexp_matches(current_name, '^\\d{{8}}') THEN substr(current_name, 1, 4) || '-' || substr(current_name, 5, 2) || '-' || substr(current_name, 7, 2) END AS date, trim(ltrim(substr(current_name, CASE WHEN regexp_matches(current_name, '^\\d{{8}}') THEN 9 ELSE 11 END), ' _-.~'), ' ') AS title FROM e),
x AS (SELECT *, date || CASE WHEN title = '' THEN '' ELSE ' ' || title END AS proposed_name FROM d WHERE try_cast(date AS DATE) IS NOT NULL)
SELECT library_id, source_dir, parent_dir, current_name, proposed_name, CASE substr(current_name, 5, 1) WHEN '_' THEN 'underscores' WHEN '.' THEN 'dots' ELSE 'joined' END AS reason, file_count,
  EXISTS (SELECT 1 FROM e WHERE e.library_id = x.library_id AND e.parent_dir = x.parent_dir AND e.current_name = x.proposed_name) AS conflict FROM x WHERE proposed_name <> current_name""")
def dated_names(spark, d):
    """Dated folders of each library that aren't named ``YYYY-MM-DD title``, with the name they should have."""
    tidy = lambda c: F.array_join(F.filter(F.split(nfc(F.col(c)), "/"), lambda x: x != ""), "/")
    n = files(spark, d, "folder_id").where("trashed_at is null").groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    fo = folders(spark, d, "library_id", "rel_path", "name").join(n, "id", "left").select("library_id", tidy("rel_path").alias("full"), nfc(F.col("name")).alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    lib = table(spark, d, "libraries").select(F.col("id").alias("library_id"), tidy("rel_path").alias("root"))
    fo = fo.join(lib, "library_id").where((F.col("root") == "") | F.startswith("full", F.concat("root", F.lit("/"))))
    path = F.when(F.col("root") == "", F.col("full")).otherwise(F.expr("substr(full, length(root) + 2)"))
    return t.name_audit(fo.select("library_id", path.alias("path"), "name", "n"), ["library_id"])


@query("q33_top_extensions", f"""{BASE}, x AS (SELECT folder_id, lower(ext) AS ext, count(*) AS n FROM live GROUP BY 1, 2)
SELECT folder_id, ext, n, row_number() OVER (PARTITION BY folder_id ORDER BY n DESC, ext) AS pos FROM x QUALIFY pos <= 4""")
def top_extensions(spark, d):
    """The four most frequent extensions of each folder."""
    from pyspark.sql import Window

    x = files(spark, d, "folder_id", "ext").where("trashed_at is null").groupBy("folder_id", F.lower("ext").alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("folder_id").orderBy(F.desc("n"), "ext"))).where("pos <= 4")


@query("q34_extensions", f"{BASE} SELECT lower(ext) AS ext, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY 1")
def extensions(spark, d):
    return files(spark, d, "ext", "size").groupBy(F.lower("ext").alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


_TF = "WITH r AS (SELECT DISTINCT row_id, pair_id, side, sub, name, full_hash AS hash FROM tree_files)"


def _sets(trees):
    """Sets named by their first tree, so that no way of signing them shows in the answer."""
    first = trees.groupBy("signature").agg(F.min(F.concat_ws("/", "scope", "path")).alias("first_of_set"))
    return trees.join(first, "signature").select("first_of_set", "scope", "path", "n")


@query("e22_identical_trees", f"""{_TF}, r2 AS (SELECT pair_id || side AS scope, array_to_string(list_filter(string_split('root/' || nfc_normalize(sub), '/'), lambda x: x <> ''), '/') AS path, hash FROM r),
u AS (SELECT scope, path, hash, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM r2), a AS (SELECT scope, array_to_string(string_split(path, '/')[1:i], '/') AS path, hash, count(*) AS k FROM u GROUP BY 1, 2, 3),
s AS (SELECT scope, path, sum(k) AS n, sha256(array_to_string(list_sort(list(hash || ':' || k)), ',')) AS signature FROM a GROUP BY scope, path HAVING bool_and(hash IS NOT NULL)),
m AS (SELECT * FROM s WHERE signature IN (SELECT signature FROM s GROUP BY signature HAVING count(*) > 1))
, o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m p WHERE p.scope = m.scope AND p.path = regexp_replace(m.path, '/?[^/]*$', '')))
SELECT min(scope || '/' || path) OVER (PARTITION BY signature) AS first_of_set, scope, path, CAST(n AS BIGINT) AS n FROM o""")
def identical(spark, d):
    """Equal trees among the sides of all compared pairs."""
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side", nfc(F.col("sub")).alias("sub"), F.col("full_hash").alias("hash")).distinct()
    return _sets(t.identical_trees(r.select(F.concat(F.col("pair_id").cast("string"), "side").alias("scope"), F.concat(F.lit("root/"), "sub").alias("path"), "hash")))


@query("e22_identical_sets", f"""{_TF}, r2 AS (SELECT pair_id || side AS scope, array_to_string(list_filter(string_split('root/' || nfc_normalize(sub), '/'), lambda x: x <> ''), '/') AS path, hash FROM r),
u AS (SELECT scope, path, hash, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM r2), a AS (SELECT scope, array_to_string(string_split(path, '/')[1:i], '/') AS path, hash, count(*) AS k FROM u GROUP BY 1, 2, 3),
s AS (SELECT scope, path, sum(k) AS n, sha256(array_to_string(list_sort(list(hash || ':' || k)), ',')) AS signature FROM a GROUP BY scope, path HAVING bool_and(hash IS NOT NULL)),
t AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.signature = s.signature AND o.scope = s.scope AND starts_with(s.path, o.path || '/'))),
m AS (SELECT * FROM t WHERE signature IN (SELECT signature FROM t GROUP BY signature HAVING count(*) > 1)),
k AS (SELECT DISTINCT signature FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.scope = m.scope AND starts_with(m.path, o.path || '/')))
SELECT min(scope || '/' || path) OVER (PARTITION BY signature) AS first_of_set, scope, path, CAST(n AS BIGINT) AS n FROM m WHERE signature IN (FROM k)""")
def identical_sets(spark, d):
    """Sets of equal trees among the sides of all compared pairs."""
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side", nfc(F.col("sub")).alias("sub"), F.col("full_hash").alias("hash")).distinct()
    return _sets(t.identical_sets(r.select(F.concat(F.col("pair_id").cast("string"), "side").alias("scope"), F.concat(F.lit("root/"), "sub").alias("path"), "hash")))


@query("e23_compare_trees", f"""{_TF}, p AS (SELECT pair_id, hash, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM r GROUP BY 1, 2),
g AS (SELECT pair_id, CAST(sum(a) AS BIGINT) AS files_a, CAST(sum(b) AS BIGINT) AS files_b, CAST(sum(CASE WHEN hash IS NULL THEN 0 ELSE least(a, b) END) AS BIGINT) AS common FROM p GROUP BY pair_id),
h AS (SELECT *, common = files_b AND files_b > 0 AS b_in_a, common = files_a AND files_a > 0 AS a_in_b FROM g)
SELECT *, CASE WHEN a_in_b AND b_in_a THEN 'same' WHEN b_in_a THEN 'b_in_a' WHEN a_in_b THEN 'a_in_b' WHEN files_a = 0 OR files_b = 0 THEN 'one_sided' WHEN common > 0 THEN 'partial' ELSE 'different' END AS verdict FROM h""")
def compare(spark, d):
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side", F.col("full_hash").alias("hash")).distinct()
    return t.compare_trees(r, ["pair_id"])


@query("e23_compare_folders", """WITH r AS (SELECT DISTINCT row_id, pair_id, side, array_to_string(list_filter(string_split(nfc_normalize(coalesce(sub, '')), '/'), lambda x: x <> ''), '/') AS sub, full_hash AS hash, size FROM tree_files),
l AS (SELECT pair_id, sub, hash, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b, coalesce(sum(size) FILTER (side = 'a'), 0) AS sa, coalesce(sum(size) FILTER (side = 'b'), 0) AS sb FROM r GROUP BY ALL),
n AS (SELECT pair_id, sub, sum(a) AS files_a, sum(b) AS files_b, sum(sa) AS bytes_a, sum(CASE WHEN hash IS NULL THEN 0 ELSE least(a, b) END) AS common FROM l GROUP BY ALL),
x AS (SELECT n.pair_id, n.sub, l.hash, sum(l.a) AS a, sum(l.b) AS b, sum(l.sa) AS sa, sum(l.sb) AS sb FROM n JOIN l ON l.pair_id = n.pair_id AND (n.sub = '' OR l.sub = n.sub OR starts_with(l.sub, n.sub || '/')) WHERE n.files_a > 0 AND n.files_b > 0 GROUP BY ALL),
t AS (SELECT pair_id, sub, sum(a) AS files_a, sum(b) AS files_b, sum(sa) AS bytes_a, sum(sb) AS bytes_b, bool_and(CASE WHEN hash IS NULL THEN b = 0 ELSE b <= a END) AS b_in_a, bool_and(CASE WHEN hash IS NULL THEN a = 0 ELSE a <= b END) AS a_in_b FROM x GROUP BY pair_id, sub HAVING b_in_a OR a_in_b),
o AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.pair_id = n.pair_id AND n.sub <> t.sub AND (t.sub = '' OR starts_with(n.sub, t.sub || '/'))))
SELECT o.pair_id, o.sub, CASE WHEN t.b_in_a AND t.a_in_b THEN 'same' WHEN t.b_in_a THEN 'b_in_a' WHEN t.a_in_b THEN 'a_in_b' WHEN o.files_b = 0 THEN 'only_a' WHEN o.files_a = 0 THEN 'only_b' ELSE 'partial' END AS verdict,
  CAST(coalesce(t.files_a, o.files_a) AS BIGINT) AS files_a, CAST(coalesce(t.files_b, o.files_b) AS BIGINT) AS files_b, CAST(CASE WHEN t.sub IS NULL THEN o.common ELSE least(t.files_a, t.files_b) END AS BIGINT) AS common,
  CAST(CASE WHEN t.b_in_a AND t.a_in_b THEN least(t.bytes_a, t.bytes_b) WHEN t.b_in_a THEN t.bytes_b WHEN t.a_in_b THEN t.bytes_a WHEN o.common > 0 THEN o.common * (o.bytes_a // o.files_a) ELSE 0 END AS BIGINT) AS bytes
FROM o LEFT JOIN t ON t.pair_id = o.pair_id AND t.sub = o.sub""")
def compare_folders(spark, d):
    """Both sides of each pair folder by folder, trees held whole at the top."""
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side", nfc(F.coalesce("sub", F.lit(""))).alias("sub"), F.col("full_hash").alias("hash"), "size").distinct()
    return t.compare_folders(r.withColumn("sub", F.array_join(F.filter(F.split("sub", "/"), lambda x: x != ""), "/")), ["pair_id"])


@query("e24_pair_files", f"""{_TF}, a AS (SELECT pair_id, hash, row_id AS a_id, row_number() OVER (PARTITION BY pair_id, hash ORDER BY row_id) AS k FROM r WHERE side = 'a' AND hash IS NOT NULL),
b AS (SELECT pair_id, hash, row_id AS b_id, row_number() OVER (PARTITION BY pair_id, hash ORDER BY row_id DESC) AS k FROM r WHERE side = 'b' AND hash IS NOT NULL) SELECT pair_id, a_id, b_id FROM a JOIN b USING (pair_id, hash, k)""")
def pair_files(spark, d):
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side", F.col("full_hash").alias("hash")).distinct()
    return t.pair_files(r, ["pair_id"], "row_id")


@query("e25_droppable", f"""{_TF} SELECT row_id, pair_id, EXISTS (SELECT 1 FROM r o WHERE o.pair_id = r.pair_id AND o.side = 'a' AND o.hash = r.hash) AS droppable FROM r WHERE side = 'b'""")
def droppable(spark, d):
    """Files of side b that side a holds as well, and so may go when a is kept."""
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side", F.col("full_hash").alias("hash")).distinct()
    have = r.where("side = 'a' and hash is not null").select("pair_id", "hash", F.lit(True).alias("x")).distinct()
    return r.where("side = 'b'").join(have, ["pair_id", "hash"], "left").select("row_id", "pair_id", F.coalesce("x", F.lit(False)).alias("droppable"))


@query("e28_apply_pairs", f"""{_TF}, k AS (SELECT pair_id, count(*) FILTER (side = 'b') AS n, count(*) FILTER (side = 'b' AND EXISTS (SELECT 1 FROM r o WHERE o.pair_id = r.pair_id AND o.side = 'a' AND o.hash = r.hash)) AS rejected FROM r GROUP BY pair_id)
SELECT pair_id, n, rejected, n = rejected AND n > 0 AS closed FROM k""")
def apply_pairs(spark, d):
    """What rejecting side b does to each pair; a pair closes only when all of b may go."""
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side", F.col("full_hash").alias("hash")).distinct()
    have = r.where("side = 'a' and hash is not null").select("pair_id", "hash", F.lit(True).alias("x")).distinct()
    b = F.col("side") == "b"
    g = r.join(have, ["pair_id", "hash"], "left").groupBy("pair_id").agg(F.count_if(b).alias("n"), F.count_if(b & F.coalesce("x", F.lit(False))).alias("rejected"))
    return g.withColumn("closed", (F.col("n") == F.col("rejected")) & (F.col("n") > 0))


@query("e28_pair_rows_check", f"""{_TF}, g AS (SELECT pair_id, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM r GROUP BY pair_id)
SELECT pair_id, p.files_a <> coalesce(a, 0) OR p.files_b <> coalesce(b, 0) AS stale FROM pair_rows p LEFT JOIN g USING (pair_id)""")
def stale_pairs(spark, d):
    """Stored summaries that no longer agree with the files."""
    r = table(spark, d, "tree_files").select("row_id", "pair_id", "side").distinct()
    g = r.groupBy("pair_id").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return table(spark, d, "pair_rows").join(g, "pair_id", "left").select("pair_id", ((F.col("files_a") != zero("a")) | (F.col("files_b") != zero("b"))).alias("stale"))
