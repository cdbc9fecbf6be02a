"""State and plans: merges that keep derived values, marks, journals with undo, transfers, synchronising, purging.

Nothing here touches a file system: every operator gives the new rows, or a plan of what
would be done.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed_files(seen: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Files of a scan that are new or differ in size or time from what is known; videos without a length are read again."""
    same = known.where("not (kind = 1 and duration_ms is null)").select(*keys, "size", "modified_at").distinct()
    cond = [seen[k] == same[k] for k in keys] + [seen["size"] == same["size"], seen["modified_at"].eqNullSafe(same["modified_at"])]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    return seen.join(same, on, "left_anti")


def merge_scan(known: DataFrame, scan: DataFrame, key: str, derived: list[str], geo: list[str]) -> DataFrame:
    """The table after a scan. Derived values stay only where size and time are as before, places only where the position is.

    Both have ``key, size, modified_at, gps_lat, gps_lon``; ``known`` has the derived and geo columns.
    """
    k = known.select(key, *(F.col(c).alias(f"__{c}") for c in ("size", "modified_at", "gps_lat", "gps_lon", *derived, *geo)), F.lit(True).alias("__had"))
    s = scan.select(key, "size", "modified_at", "gps_lat", "gps_lon", F.lit(True).alias("__seen"))
    j = s.join(k, key, "full_outer")
    seen = F.coalesce("__seen", F.lit(False))
    same = F.col("size").eqNullSafe(F.col("__size")) & F.col("modified_at").eqNullSafe(F.col("__modified_at"))
    still = F.col("gps_lat").eqNullSafe(F.col("__gps_lat")) & F.col("gps_lon").eqNullSafe(F.col("__gps_lon"))
    keep = lambda c, cond: F.when(~seen | cond, F.col(f"__{c}")).alias(c)
    own = [F.when(seen, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in ("size", "modified_at", "gps_lat", "gps_lon")]
    return j.select(key, *own, *(keep(c, same) for c in derived), *(keep(c, still) for c in geo))


def missing(known: DataFrame, seen: DataFrame, key: str, least: int = 100, share: float = 0.5) -> DataFrame:
    """Rows a scan no longer found: ``key, allowed``.

    They may go unless the scan found nothing, or more than ``share`` of ``least`` or more rows would.
    The guard is a one-row aggregate of the same plan, so it judges the rows it is returned with.
    """
    k, s = known.select(key).distinct().withColumn("__k", F.lit(True)), seen.select(key).distinct().withColumn("__s", F.lit(True))
    both = k.join(s, key, "full_outer").select(key, F.coalesce("__k", F.lit(False)).alias("__k"), F.coalesce("__s", F.lit(False)).alias("__s"))
    n = both.agg(F.count_if("__k").alias("__n"), F.count_if("__s").alias("__found"), F.count_if(F.col("__k") & ~F.col("__s")).alias("__gone"))
    refuse = (F.col("__found") == 0) | ((F.col("__n") >= least) & (F.col("__gone") > share * F.col("__n")))
    gone = both.where("__k and not __s").select(key)
    return gone.crossJoin(F.broadcast(n.select((~refuse).alias("allowed"))))


def prune_folders(known: DataFrame, seen: DataFrame, rescanned: DataFrame, key: str, folder: str) -> DataFrame:
    """Known rows of the folders scanned again that were not seen there: ``folder, key``; other folders are left as they are."""
    k = known.select(folder, key).distinct().join(rescanned.select(folder).distinct(), folder, "left_semi")
    return k.join(seen.select(key).distinct(), key, "left_anti").select(folder, key)


def recent_batches(batches: DataFrame, journal: DataFrame, files: DataFrame, children: DataFrame, limit: int) -> DataFrame:
    """The newest batches (1 to 200) as they stand: ``batch_id, kind, item_count, undone``, those of other batches hidden.

    ``batches`` has ``batch_id, kind, item_count, undone``, ``journal`` ``batch_id, file_id, ok``, ``files`` ``id, trashed_at``. A batch
    left open gets the number of its journal's good rows; one without items isn't listed. A trash batch none of whose files is in the trash
    any more, and a restore batch all of whose files are, was undone elsewhere.
    """
    j = journal.where("ok").select("batch_id", F.col("file_id").alias("id")).join(files.select("id", F.col("trashed_at").isNotNull().alias("gone")).distinct(), "id", "left")
    n = j.groupBy("batch_id").agg(F.count(F.lit(1)).alias("good"), F.bool_or(F.col("gone")).alias("some_gone"), F.bool_or(~F.col("gone")).alias("some_live"))
    b = batches.join(children.select("batch_id").distinct(), "batch_id", "left_anti").join(n, "batch_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    elsewhere = (F.col("item_count") > 0) & (((F.col("kind") == "trash") & ~yes("some_gone")) | ((F.col("kind") == "restore") & ~yes("some_live")))
    count = F.when((F.col("item_count") == 0) & ~F.col("undone"), F.coalesce("good", F.lit(0))).otherwise(F.col("item_count"))
    got = b.select("batch_id", "kind", count.cast("long").alias("item_count"), (F.col("undone") | elsewhere).alias("undone")).where("item_count > 0")
    return got.orderBy(F.desc("batch_id")).limit(min(max(limit, 1), 200))


def verify(known: DataFrame, present: DataFrame, key: str, scope: str, share: float = 0.9) -> DataFrame:
    """Known rows another store lacks, by scope: ``scope, key, allowed``.

    Nothing of a scope may be concluded while less than ``share`` of its known rows are
    there, as the store is then likely not fully attached. ``known`` has ``scope, key``; rows without a scope are left out.
    """
    there = present.select(key).distinct().withColumn("__there", F.lit(True))
    j = known.where(F.col(scope).isNotNull()).select(scope, key).distinct().join(there, key, "left").withColumn("__there", F.coalesce("__there", F.lit(False)))
    ok = j.groupBy(scope).agg((F.count_if("__there") >= share * F.count(F.lit(1))).alias("allowed"))
    return j.where("not __there").join(ok, scope).select(scope, key, "allowed")


def mark(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Ratings, flags and favourites after changes ``id, rating, culling_flag, favorite``; null leaves a value as it is, others are brought into range."""
    c = changes.select("id", F.col("rating").alias("r"), F.col("culling_flag").alias("c"), F.col("favorite").alias("f"))
    j = files.join(c, "id", "left")
    within = lambda x, hi: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(0)))
    return j.withColumns({"rating": F.coalesce(within(F.col("r"), 5), F.col("rating")), "culling_flag": F.coalesce(within(F.col("c"), 2), F.col("culling_flag")), "favorite": F.coalesce("f", "favorite")}).drop("r", "c", "f")


def undo_plan(journal: DataFrame, now: DataFrame) -> DataFrame:
    """Steps that undo a batch, last first: ``batch_id, seq, from_path, to_path, action``.

    A file whose size or time is no longer what the batch left is skipped, one that is gone is
    missing; a batch already undone gives no steps.
    """
    j = journal.where("undone_at is null").join(now.select(F.col("path").alias("to_path"), F.col("size").alias("s2"), F.col("modified_at").alias("m2"), F.lit(True).alias("there")), "to_path", "left")
    same = F.col("size").eqNullSafe(F.col("s2")) & F.col("modified_at").eqNullSafe(F.col("m2"))
    step = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("id")))
    return j.select("batch_id", step.alias("seq"), F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"), F.when(F.col("there").isNull(), "missing").when(same, "move").otherwise("skip").alias("action"))


def free_names(wanted: DataFrame, taken: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Names no one has: adds ``free_name``, letters of either case being the same.

    The first row (by ``order``) that wants a name no file of the folder has keeps it. The
    others are numbered from 2 on, ``name (2).ext``, past every number that a taken or wanted name
    already bears, so no two rows of the result and no taken file share a name.
    """
    from silverfold.functions.names import NUMBERED, numbered, split_name

    low = F.lower(name)
    w = wanted.withColumn("__l", low)
    held = taken.select(folder, low.alias("__l")).distinct().withColumn("__t", F.lit(True))
    w = w.join(held, [folder, "__l"], "left")
    place = F.row_number().over(Window.partitionBy(folder, "__l").orderBy(order))
    # 0 keeps the name; n > 0 gets the n-th free number
    w = w.withColumn("__n", place - F.when(F.col("__t"), 0).otherwise(1))
    stem, ext = split_name(F.col("__l"))
    inner = F.regexp_extract(stem, NUMBERED, 1)
    used = w.select(folder, "__l").unionByName(held.select(folder, "__l")).where(stem.rlike(NUMBERED)).select(
        folder, F.concat(inner, F.coalesce(F.concat(F.lit("."), ext), F.lit(""))).alias("__l"), F.regexp_extract(stem, NUMBERED, 2).cast("long").alias("__u")
    ).where("__u >= 2").distinct()
    # the i-th used number u has u - 1 - i free ones from 2 on before it
    i = F.row_number().over(Window.partitionBy(folder, "__l").orderBy("__u"))
    used = used.select(folder, "__l", (F.col("__u") - i).alias("__at"), F.lit(1).alias("__is"))
    line = w.withColumns({"__at": F.col("__n").cast("long"), "__is": F.lit(0)}).unionByName(used, allowMissingColumns=True)
    passed = F.sum("__is").over(Window.partitionBy(folder, "__l").orderBy("__at", F.desc("__is")).rowsBetween(Window.unboundedPreceding, 0))
    got = line.withColumn("__k", F.when(F.col("__at") <= 0, 1).otherwise(F.col("__at") + 1 + passed)).where("__is = 0")
    return got.withColumn("free_name", numbered(F.col(name), F.col("__k"))).drop("__l", "__t", "__n", "__at", "__is", "__k")


def transfer_plan(picks: DataFrame, there: DataFrame, done: DataFrame, rename: bool) -> DataFrame:
    """What a transfer would do with each pick: ``id, name, action``.

    ``picks`` has ``id, folder_id, name, hash, from_area, to_area``; going from area 1 to 2 copies, else
    it moves. One already published by its hash (``done``) is skipped; a name that is there
    or twice in the batch is skipped, or renamed.
    """
    p = picks.join(done.select("hash", F.lit(True).alias("done")).distinct(), "hash", "left")
    p = p.join(there.select("folder_id", F.lower("name").alias("l"), F.lit(True).alias("taken")).distinct(), (F.lower(p["name"]) == F.col("l")) & (p["folder_id"] == there["folder_id"]), "left").select(p["*"], "taken")
    again = F.row_number().over(Window.partitionBy("folder_id", F.lower("name")).orderBy("id")) > 1
    p = p.withColumn("again", again)
    how = F.when((F.col("from_area") == 1) & (F.col("to_area") == 2), "copy").otherwise("move")
    clash = F.coalesce("taken", F.lit(False)) | F.col("again")
    return p.select("id", "name", F.when(F.col("done"), "skip_published").when(clash, "rename" if rename else "skip_name").otherwise(how).alias("action"))


def sync_plan(source: DataFrame, target: DataFrame, key: list[str], exclude: list[str] = [], slack_s: int = 2) -> DataFrame:
    """What brings a target in line with its source: ``key, action``.

    new, size_changed, modified (the source is newer), conflict (the target is newer) or
    orphan; equal files have no row. ``exclude`` holds patterns of paths or names, with * and ?.
    """
    import re

    s = source.select(*key, F.col("size").alias("s"), F.col("modified_at").alias("sm"), F.lit(True).alias("in_s"))
    t = target.select(*key, F.col("size").alias("t"), F.col("modified_at").alias("tm"), F.lit(True).alias("in_t"))
    for g in exclude:
        body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in g)
        pat = f"^({body}|.*/{body})$" if "/" not in g else f"^{body}$"
        s, t = s.where(~F.col(key[-1]).rlike(pat)), t.where(~F.col(key[-1]).rlike(pat))
    j = s.join(t, key, "full_outer")
    action = (
        F.when(F.col("in_t").isNull(), "new").when(F.col("in_s").isNull(), "orphan")
        .when(F.col("tm") > F.col("sm") + slack_s, "conflict").when(F.col("s") != F.col("t"), "size_changed").when(F.col("sm") > F.col("tm") + slack_s, "modified")
    )
    return j.select(*key, action.alias("action")).where("action is not null")


def latest(journal: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, by a pre-aggregated maximum."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, *(F.col(f"r.{c}") for c in rest))


def purge_class(flag: Column, uploaded: Column, done: Column) -> Column:
    """What a trashed file is: pending while undone, discarded, uploaded, or unknown."""
    return F.when(~done, "pending").when(flag == 2, "discarded").when(uploaded, "uploaded").otherwise("unknown")


def pending_work(files: DataFrame, done: DataFrame, missing_value: Column, fresh: Column | None = None) -> DataFrame:
    """Live files that lack a derived value: no done row, or one that isn't fresh any more."""
    live = files.where("trashed_at is null").where(missing_value)
    ready = done if fresh is None else done.where(fresh)
    return live.join(ready.select(F.col("file_id").alias("id")).distinct(), "id", "left_anti")


def stale_thumbs(files: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Live files without a finished thumbnail made of the file as it is: none, another state than 1, or another size or time."""
    good = thumbs.where("state = 1").select(F.col("file_id").alias("id"), "size", F.col("modified_at").alias("__m"), F.col("size").alias("__s")).drop("size").distinct()
    live = files.where("trashed_at is null")
    on = (live["id"] == good["id"]) & live["size"].eqNullSafe(good["__s"]) & live["modified_at"].eqNullSafe(good["__m"])
    return live.join(good, on, "left_anti")


def import_look(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates of an import, each path once: ``path, day, size, is_dup``.

    A candidate is a duplicate if a known file has its name and size, and its hash where both have one.
    """
    once = found.groupBy("path").agg(F.min(F.struct("name", "size", "hash", "taken_at")).alias("r")).select("path", "r.*")
    k = known.select(F.col("name").alias("kn"), F.col("size").alias("ks"), F.col("hash").alias("kh")).distinct()
    same = (F.col("name") == F.col("kn")) & (F.col("size") == F.col("ks"))
    alike = F.col("kh").isNull() | F.col("hash").isNull() | (F.col("kh") == F.col("hash"))
    j = once.join(k, same & alike, "left_semi").select("path", F.lit(True).alias("d"))
    return once.join(j, "path", "left").select("path", F.date_format(F.timestamp_seconds("taken_at"), "yyyy-MM-dd").alias("day"), "size", F.coalesce("d", F.lit(False)).alias("is_dup"))


def import_preview(look: DataFrame, days: int = 8) -> DataFrame:
    """Totals of an import, and its first days."""
    return look.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if("is_dup").alias("dups"), F.slice(F.array_sort(F.collect_set("day")), 1, days).alias("days"))


def journal_rows(moves: DataFrame, batch_id: int | str, at: int) -> DataFrame:
    """Rows for the journal out of ``id, from_path, to_path, size, modified_at``, each batch in the order of ids.

    ``batch_id`` is the one batch of all moves, or the column that tells the batch of each.
    """
    batch = F.col(batch_id) if isinstance(batch_id, str) else F.lit(batch_id)
    n = F.row_number().over(Window.partitionBy(batch).orderBy("id"))
    return moves.select(batch.cast("long").alias("batch_id"), n.cast("long").alias("seq"), "id", "from_path", "to_path", "size", "modified_at", F.lit(at).cast("long").alias("done_at"), F.lit(None).cast("long").alias("undone_at"))


def close_batches(batches: DataFrame, journal: DataFrame) -> DataFrame:
    """Batches ``batch_id, started_at`` with their steps; one without steps left to undo can't be undone."""
    n = journal.groupBy("batch_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("undone_at").isNull()).alias("open"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return batches.join(n, "batch_id", "left").select("batch_id", "started_at", zero("steps"), (F.coalesce("open", F.lit(0)) > 0).alias("can_undo"))


def trash_plan(files: DataFrame, at: int) -> DataFrame:
    """Files flagged to go, with where they would lie: ``id, from_path, to_path, trashed_at``."""
    gone = files.where("trashed_at is null and culling_flag = 2")
    path = F.concat_ws("/", F.col("folder_id").cast("string"), "name")
    return gone.select("id", path.alias("from_path"), F.concat(F.lit(".trash/"), F.col("id").cast("string"), F.lit("/"), F.col("name")).alias("to_path"), F.lit(at).cast("long").alias("trashed_at"))


def restore_plan(files: DataFrame) -> DataFrame:
    """Trashed files brought back to their folders under names that are free there."""
    back, live = files.where("trashed_at is not null"), files.where("trashed_at is null")
    return free_names(back, live, "folder_id", "name", "id").select("id", "folder_id", "free_name")


def rename_plan(files: DataFrame, pattern: Column, live: DataFrame) -> DataFrame:
    """New names after a pattern, made free; files whose name stays as it is have no row."""
    w = files.withColumn("old", F.col("name")).withColumn("name", pattern)
    others = live.join(files.select("id"), "id", "left_anti")
    return free_names(w, others, "folder_id", "name", "id").where("free_name <> old").select("id", "old", "free_name")


def merge_plan(source: DataFrame, target: DataFrame, keys: list[str] = []) -> DataFrame:
    """What merging one folder into another does with each file: ``id, action`` per ``keys``, one merge each.

    A file the target holds with equal content is dropped, one whose name is taken by other content is renamed, others move.
    """
    same = target.where("hash is not null").select(*keys, "hash", F.lit(True).alias("same")).distinct()
    taken = target.select(*keys, F.lower("name").alias("l"), F.lit(True).alias("taken")).distinct()
    j = source.join(same, [*keys, "hash"], "left").withColumn("l", F.lower("name")).join(taken, [*keys, "l"], "left")
    return j.select(*keys, "id", F.when(F.col("same"), "drop").when(F.col("taken"), "rename").otherwise("move").alias("action"))


def put(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A small keyed table after changes: settings, or stored filters by name. A change replaces its row."""
    return table.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes)
