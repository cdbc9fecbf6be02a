"""Folder trees by path: rolled-up counts, identical trees, comparison of two trees, husks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverfold.functions import names
from silverfold.session import Stages


def ancestors(path: Column, itself: bool = True) -> Column:
    """All prefixes of a path by its segments, shortest first; an empty path has none."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts) if itself else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder_tree(leaves: DataFrame, keys: list[str] = []) -> DataFrame:
    """Nodes of the tree over leaf folders ``path, id, n`` (per ``keys``): ``path, id, name, depth, total, has_children``.

    Ancestors that are no folder themselves are made up, with a null id. Counts roll up
    to every ancestor; leaves without a path make no node. Each leaf gives a row a level, and
    these are summed up before they move.
    """
    own = F.col("a") == F.concat_ws("/", F.filter(F.split("path", "/"), lambda x: x != ""))
    up = leaves.where("path <> ''").select(*keys, "path", "id", "n", F.explode(ancestors(F.col("path"))).alias("a"))
    node = up.groupBy(*keys, "a").agg(F.sum("n").alias("total"), F.min(F.when(own, F.col("id"))).alias("id"), F.max(~own).alias("has_children"))
    parts = F.split("a", "/")
    return node.select(*keys, F.col("a").alias("path"), "id", F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), "total", "has_children")


def tree_signatures(files: DataFrame, scope: str = "scope") -> DataFrame:
    """Content signature of every tree: ``scope, path, n, signature``; trees with an unhashed file are left out.

    ``files`` has ``scope, path, hash``. A tree's signature stands for the multiset of the hashes below it, wherever they
    lie: the number of files and four sums of 32 bits of each file's hash, 128 bits in all. Sums don't
    depend on the order and add up from folder to folder, so a tree of any size is a few numbers (up to 2^31 files), never a list.
    """
    part = [F.conv(F.substring(F.md5("hash"), 8 * i + 1, 8), 16, 10).cast("long").alias(f"__s{i}") for i in range(4)]
    sums = [F.sum(f"__s{i}").alias(f"__s{i}") for i in range(4)]
    leaf = files.select(scope, "path", F.lit(1).cast("long").alias("n"), F.col("hash").isNull().alias("open"), *part).groupBy(scope, "path").agg(F.sum("n").alias("n"), F.bool_or("open").alias("open"), *sums)
    up = leaf.withColumn("path", F.explode(ancestors(F.col("path")))).groupBy(scope, "path").agg(F.sum("n").alias("n"), F.bool_or("open").alias("open"), *sums)
    return up.where(~F.col("open")).select(scope, "path", "n", F.md5(F.concat_ws(":", "n", *(f"__s{i}" for i in range(4)))).alias("signature"))


def identical_trees(files: DataFrame, scope: str = "scope") -> DataFrame:
    """Trees of equal content, topmost only: ``signature, scope, path, n``, two or more a signature.

    A tree whose parent lies in a set of its own as well is covered by that set and left out.
    """
    sig = tree_signatures(files, scope)
    shared = sig.groupBy("signature").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("signature")
    mine = sig.join(shared, "signature", "left_semi")
    above = mine.select(scope, F.col("path").alias("up")).distinct()
    return mine.withColumn("up", parent_of(F.col("path"))).join(above, [scope, "up"], "left_anti").select("signature", scope, "path", "n")


def identical_sets(files: DataFrame, scope: str = "scope") -> DataFrame:
    """Sets of trees of equal content: ``signature, scope, path, n``, two or more a signature, whole sets only.

    Of trees of a signature that lie in each other the topmost counts. A set is left out only if
    each of its trees lies below a tree of another set; one with a tree elsewhere keeps all, so no link is lost.
    The signatures are written once, as each step reads them again.
    """
    sig = Stages(files.sparkSession, "trees").save(tree_signatures(files, scope))
    twice = sig.groupBy("signature").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("signature")
    mine = sig.join(twice, "signature", "left_semi")
    above = mine.select("signature", scope, "path", F.explode(ancestors(F.col("path"), False)).alias("up"))
    inner = above.join(mine.select("signature", scope, F.col("path").alias("up")), ["signature", scope, "up"], "left_semi").select("signature", scope, "path").distinct()
    root = mine.join(inner, ["signature", scope, "path"], "left_anti")
    shared = root.groupBy("signature").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("signature")
    root = root.join(shared, "signature", "left_semi")
    # what covers a tree holds more files than it, so being covered by a set that is itself left out is being covered by the one above that
    up = root.select("signature", scope, "path", F.explode(ancestors(F.col("path"), False)).alias("up"))
    covered = up.join(root.select(scope, F.col("path").alias("up")), [scope, "up"], "left_semi").select("signature", scope, "path").distinct()
    kept = root.join(covered, ["signature", scope, "path"], "left_anti").select("signature").distinct()
    return root.join(kept, "signature", "left_semi").select("signature", scope, "path", "n")


def compare_trees(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for each pair of trees: ``files_a, files_b, common, b_in_a, a_in_b, verdict``.

    ``rows`` has keys, ``side`` (a or b) and ``hash``. common counts the files of both sides that can
    be matched one to one by hash, so copies count as often as they occur on both.
    """
    per = rows.groupBy(*keys, "hash").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    known = F.col("hash").isNotNull()
    got = per.groupBy(*keys).agg(F.sum("a").alias("files_a"), F.sum("b").alias("files_b"), F.sum(F.when(known, F.least("a", "b")).otherwise(0)).alias("common"))
    inside = lambda x: (F.col("common") == F.col(x)) & (F.col(x) > 0)
    got = got.withColumns({"b_in_a": inside("files_b"), "a_in_b": inside("files_a")})
    verdict = F.when(F.col("a_in_b") & F.col("b_in_a"), "same").when(F.col("b_in_a"), "b_in_a").when(F.col("a_in_b"), "a_in_b").when((F.col("files_a") == 0) | (F.col("files_b") == 0), "one_sided").when(F.col("common") > 0, "partial").otherwise("different")
    return got.withColumn("verdict", verdict)


def compare_folders(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two trees folder by folder: ``sub, verdict, files_a, files_b, common, bytes`` per ``keys``.

    ``rows`` has keys, ``side`` (a or b), ``sub`` (path of the folder below its root, which is empty), ``hash`` and ``size``. Folders
    meet by equal sub. One whose whole tree is held by its partner's, as often as each hash occurs, is
    a row of its own (same, b_in_a, a_in_b; bytes of what may go) and its folders below have none. Else the files
    right in it are compared (partial, also with none in common; bytes of a's share), and the folders below for themselves;
    folders with files on one side alone are only_a or only_b. A tree with an unhashed file is held by none.
    """
    null = F.col("hash").isNull()
    side = lambda x: F.col("side") == x
    size = lambda x: F.sum(F.when(side(x), F.coalesce("size", F.lit(0))).otherwise(0))
    leaf = rows.groupBy(*keys, "sub", "hash").agg(F.count_if(side("a")).alias("a"), F.count_if(side("b")).alias("b"), size("a").alias("sa"), size("b").alias("sb"))
    sums = [F.sum("a").alias("files_a"), F.sum("b").alias("files_b"), F.sum("sa").alias("bytes_a"), F.sum("sb").alias("bytes_b")]
    node = leaf.groupBy(*keys, "sub").agg(*sums, F.sum(F.when(null, 0).otherwise(F.least("a", "b"))).alias("common"))
    above = lambda itself: F.concat(F.when((F.col("sub") != "") | F.lit(itself), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), ancestors(F.col("sub"), itself))
    up = leaf.select(*keys, F.explode(above(True)).alias("sub"), "hash", "a", "b", "sa", "sb").groupBy(*keys, "sub", "hash").agg(*(F.sum(c).alias(c) for c in ("a", "b", "sa", "sb")))
    lacks = lambda x, y: F.max(F.when(null, F.col(x) > 0).otherwise(F.col(x) > F.col(y)))
    tree = up.groupBy(*keys, "sub").agg(*sums, (~lacks("b", "a")).alias("b_in_a"), (~lacks("a", "b")).alias("a_in_b")).where("b_in_a or a_in_b")
    tree = tree.join(node.where("files_a > 0 and files_b > 0").select(*keys, "sub"), [*keys, "sub"], "left_semi")
    held = tree.select(*keys, F.col("sub").alias("top"))
    below = node.select(*keys, "sub", F.explode(above(False)).alias("top")).join(held, [*keys, "top"], "left_semi").select(*keys, "sub").distinct()
    verdict = F.when(F.col("b_in_a") & F.col("a_in_b"), "same").when(F.col("b_in_a"), "b_in_a").otherwise("a_in_b")
    freed = F.when(F.col("verdict") == "same", F.least("bytes_a", "bytes_b")).when(F.col("b_in_a"), F.col("bytes_b")).otherwise(F.col("bytes_a"))
    whole = tree.join(below, [*keys, "sub"], "left_anti").withColumn("verdict", verdict).withColumn("common", F.least("files_a", "files_b")).withColumn("bytes", freed)
    rest = node.join(below, [*keys, "sub"], "left_anti").join(held.withColumnRenamed("top", "sub"), [*keys, "sub"], "left_anti")
    rest = rest.withColumn("verdict", F.when(F.col("files_b") == 0, "only_a").when(F.col("files_a") == 0, "only_b").otherwise("partial"))
    rest = rest.withColumn("bytes", F.when(F.col("common") > 0, F.col("common") * F.expr("bytes_a div files_a")).otherwise(0))
    out = [*keys, "sub", "verdict", "files_a", "files_b", "common", "bytes"]
    return whole.select(*out).unionByName(rest.select(*out))


def pair_files(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """One-to-one twins of both sides by hash: the n-th copy on one side goes with the n-th on the other.

    On side b copies are taken from the largest id down.
    """
    r = rows.where("hash is not null")
    w = Window.partitionBy(*keys, "hash")
    a = r.where("side = 'a'").select(*keys, "hash", F.col(row_id).alias("a_id"), F.row_number().over(w.orderBy(row_id)).alias("k"))
    b = r.where("side = 'b'").select(*keys, "hash", F.col(row_id).alias("b_id"), F.row_number().over(w.orderBy(F.desc(row_id))).alias("k"))
    return a.join(b, [*keys, "hash", "k"]).select(*keys, "a_id", "b_id")


def name_audit(folders: DataFrame, keys: list[str]) -> DataFrame:
    """Dated folders whose name isn't ``YYYY-MM-DD title``: ``source_dir, parent_dir, current_name, proposed_name, reason, file_count, conflict`` per ``keys``.

    ``folders`` has keys, ``path`` below the root of the keys, ``name`` and ``n`` of files. Folders above them
    that are no row themselves are audited as well, by the last part of their path; files count
    for every folder above. Names without a date of the calendar have no row, nor have hidden folders and those in them.
    conflict: a folder of the proposed name lies beside it already.
    """
    up = folders.select(*keys, "path", "name", "n", F.explode(ancestors(F.col("path"))).alias("a"))
    node = up.groupBy(*keys, F.col("a").alias("source_dir")).agg(F.sum("n").alias("file_count"), F.collect_set(F.when(F.col("a") == F.col("path"), F.col("name"))).alias("own"))
    node = node.where(~F.exists(F.split("source_dir", "/"), lambda x: F.startswith(x, F.lit(".")) | (x == "@eaDir")))
    last = F.array(F.element_at(F.split("source_dir", "/"), -1))
    node = node.select(*keys, "source_dir", parent_of(F.col("source_dir")).alias("parent_dir"), F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(last)).alias("current_name"), "file_count")
    date, title = (names.parse_folder(F.col("current_name"))[x] for x in ("date", "title"))
    named = node.where(date.try_cast("date").isNotNull()).withColumn("proposed_name", F.concat_ws(" ", date, F.nullif(title, F.lit("")))).where("proposed_name <> current_name")
    mark = F.substring("current_name", 5, 1)
    named = named.withColumn("reason", F.when(mark == "_", "underscores").when(mark == ".", "dots").otherwise("joined"))
    beside = node.select(*keys, "parent_dir", F.col("current_name").alias("proposed_name"), F.lit(True).alias("conflict")).distinct()
    got = named.join(beside, [*keys, "parent_dir", "proposed_name"], "left")
    return got.select(*keys, "source_dir", "parent_dir", "current_name", "proposed_name", "reason", "file_count", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def husks(folders: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Topmost folders with no media anywhere below: ``keys, path, n_folders``.

    ``folders`` has keys and path, ``counts`` keys, path and n of media.
    """
    live = counts.where("n > 0").select(*keys, F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    empty = folders.select(*keys, "path").where("path <> ''").distinct().join(live, [*keys, "path"], "left_anti")
    top = empty.withColumn("up", parent_of(F.col("path"))).join(empty.select(*keys, F.col("path").alias("up")), [*keys, "up"], "left_anti").select(*keys, F.col("path").alias("top"))
    under = empty.select(*keys, F.explode(ancestors(F.col("path"))).alias("top"))
    return under.join(top, [*keys, "top"], "left_semi").groupBy(*keys, F.col("top").alias("path")).agg(F.count(F.lit(1)).alias("n_folders"))


def done_side(same: Column, b_in_a: Column, a_in_b: Column, files_a: Column, files_b: Column, flagged_a: Column, flagged_b: Column) -> Column:
    """The side of a pair all of whose files are marked to go already; null where neither is, or nothing could be dropped."""
    full = lambda flagged, n: (n > 0) & (flagged >= n)
    return F.when(same | b_in_a | a_in_b, F.when(full(flagged_a, files_a), "a").when(full(flagged_b, files_b), "b"))
