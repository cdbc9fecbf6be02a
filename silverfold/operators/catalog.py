"""The catalogue's read model: one filter, compiled once, shared by every read query."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sort keys of a page (fixed values): expression, what a null counts as.
SORTS = {"taken": "taken_at", "created": "created_at", "modified": "modified_at", "name": "name", "size": "size", "pixels": "width * height", "duration": "duration_ms"}


@dataclass(frozen=True)
class Filter:
    """What to show. Every field at its default adds no condition.

    An empty text in country, admin1, admin2 asks for the rows without one; in camera and
    lens for those without one or with an empty one; in place for those without a usable
    position. A place or bbox that can't be read adds no condition.
    """

    trashed: bool = False
    library_id: int | None = None
    folder_path: str | None = None
    folder_id: int | None = None
    area: int | None = None
    kind: int | None = None
    min_rating: int | None = None
    culling_flag: int | None = None
    year: str | None = None
    month: str | None = None
    day: str | None = None
    country: str | None = None
    admin1: str | None = None
    admin2: str | None = None
    camera: str | None = None
    lens: str | None = None
    tag_id: int | None = None
    place: str | None = None
    favorite_only: bool = False
    no_thumb: bool = False
    bbox: str | None = None
    nas: bool | None = None
    person_id: int | None = None
    name_like: str | None = None
    sort: str = "taken"
    descending: bool = True

    @staticmethod
    def from_json(text: str | None) -> Filter | None:
        """A stored filter; missing fields take their default, corrupt text gives None."""
        try:
            got = json.loads(text or "")
        except ValueError:
            return None
        if not isinstance(got, dict):
            return None
        known = {f.name for f in dataclasses.fields(Filter)}
        return Filter(**{k: v for k, v in got.items() if k in known and v is not None})


@dataclass
class Catalog:
    """The tables a filter may reach; those left out make conditions on them fail loudly."""

    files: DataFrame
    folders: DataFrame
    thumbs: DataFrame | None = None
    file_tags: DataFrame | None = None
    nas_state: DataFrame | None = None
    faces: DataFrame | None = None


def valid_gps(lat: str = "gps_lat", lon: str = "gps_lon") -> Column:
    """Both there, in range, and not exactly (0, 0)."""
    a, o = F.col(lat), F.col(lon)
    ok = a.isNotNull() & o.isNotNull() & a.between(-90, 90) & o.between(-180, 180) & ~((a == 0) & (o == 0))
    return F.coalesce(ok, F.lit(False))


def day_range(text: str) -> tuple[int, int] | None:
    """Unix seconds of a year, month or day (UTC), so that the scan can be pruned by it."""
    import datetime as dt

    try:
        part = [int(x) for x in text.split("-")]
        y, m, d = (*part, 1, 1)[:3] if len(part) < 3 else part
        first = dt.datetime(y, m, d, tzinfo=dt.UTC)
        if len(part) == 1:
            last = first.replace(year=y + 1)
        elif len(part) == 2:
            last = first.replace(year=y + m // 12, month=m % 12 + 1)
        else:
            last = first + dt.timedelta(days=1)
    except (ValueError, TypeError):
        return None
    return int(first.timestamp()), int(last.timestamp())


def parse_bbox(text: str) -> tuple[float, float, float, float] | None:
    """South, west, north, east; None if it isn't four finite numbers in range and order."""
    try:
        s, w, n, e = (float(x) for x in text.split(","))
    except ValueError:
        return None
    ok = all(map(math.isfinite, (s, w, n, e))) and -90 <= s <= n <= 90 and -180 <= w <= e <= 180
    return (s, w, n, e) if ok else None


def _place(text: str) -> Column | None:
    if text == "":
        return ~valid_gps()
    try:
        lat, lon = (float(x) for x in text.split(","))
    except ValueError:
        return None
    if not (math.isfinite(lat) and math.isfinite(lon)):
        return None
    a, o = F.col("gps_lat"), F.col("gps_lon")
    return valid_gps() & (a >= lat) & (a < round(lat + 0.1, 6)) & (o >= lon) & (o < round(lon + 0.1, 6))


def _empty_or(col: str, value: str, blank: bool) -> Column:
    c = F.col(col)
    if value != "":
        return c == value
    return (c.isNull() | (c == "")) if blank else c.isNull()


def needs_folders(f: Filter) -> bool:
    """Whether a condition reads the folders; without one the join is left out."""
    return f.library_id is not None or bool(f.folder_path) or f.area is not None


def conditions(f: Filter) -> list[Column]:
    """The conditions on the files' own columns."""
    out = [F.col("trashed_at").isNotNull() if f.trashed else F.col("trashed_at").isNull()]
    for name in ("kind", "culling_flag"):
        if (v := getattr(f, name)) is not None:
            out.append(F.col(name) == v)
    if f.min_rating is not None:
        out.append(F.col("rating") >= f.min_rating)
    for text in (f.year, f.month, f.day):
        if text:
            r = day_range(text)
            out.append((F.col("taken_at") >= r[0]) & (F.col("taken_at") < r[1]) if r else F.lit(False))
    for name in ("country", "admin1", "admin2"):
        if (v := getattr(f, name)) is not None:
            out.append(_empty_or(name, v, blank=False))
    for name, col in (("camera", "cam_model"), ("lens", "lens")):
        if (v := getattr(f, name)) is not None:
            out.append(_empty_or(col, v, blank=True))
    if f.place is not None and (p := _place(f.place)) is not None:
        out.append(p)
    if f.favorite_only:
        out.append(F.col("favorite") == F.lit(True))
    if f.bbox and (b := parse_bbox(f.bbox)):
        out.append(valid_gps() & F.col("gps_lat").between(b[0], b[2]) & F.col("gps_lon").between(b[1], b[3]))
    if f.name_like and f.name_like.strip():
        out.append(F.contains(F.lower("name"), F.lit(f.name_like.strip().lower())))
    return out


def apply(c: Catalog, f: Filter) -> DataFrame:
    """The files a filter shows. Joins are made only for conditions that need them."""
    out = c.files
    for cond in conditions(f):
        out = out.where(cond)
    if needs_folders(f):
        fo = c.folders.select(F.col("id").alias("folder_id"), "library_id", "area", "rel_path")
        if f.library_id is not None:
            fo = fo.where(F.col("library_id") == f.library_id)
        if f.area is not None:
            fo = fo.where(F.col("area") == f.area)
        if f.folder_path:
            p = f.folder_path.lower()
            fo = fo.where((F.lower("rel_path") == p) | F.startswith(F.lower("rel_path"), F.lit(p + "/")))
        out = out.join(fo.select("folder_id").distinct(), "folder_id", "left_semi")
    if f.folder_id is not None:
        me = c.folders.where(F.col("id") == f.folder_id).select(F.col("volume_uuid").alias("v"), F.col("rel_path").alias("p")).limit(1)
        below = c.folders.join(F.broadcast(me), F.col("volume_uuid") == F.col("v")).where((F.col("rel_path") == F.col("p")) | F.startswith(F.col("rel_path"), F.concat("p", F.lit("/"))))
        out = out.join(below.select(F.col("id").alias("folder_id")).distinct(), "folder_id", "left_semi")
    for want, tab, cond, how in (
        (f.tag_id is not None, c.file_tags, F.col("tag_id") == f.tag_id if f.tag_id is not None else None, "left_semi"),
        (f.no_thumb, c.thumbs, F.col("state") == 1, "left_anti"),
        (f.nas is not None, c.nas_state, None, "left_semi" if f.nas else "left_anti"),
        (f.person_id is not None, c.faces, F.col("person_id") == f.person_id if f.person_id is not None else None, "left_semi"),
    ):
        if want:
            if tab is None:
                raise ValueError("the catalogue lacks a table this filter needs")
            other = tab.where(cond) if cond is not None else tab
            out = out.join(other.select(F.col("file_id").alias("id")).distinct(), "id", how)
    return out


def sort_key(f: Filter) -> Column:
    """A null sorts as 0, or as an empty name."""
    e = F.expr(SORTS[f.sort])
    return F.coalesce(e, F.lit("")) if f.sort == "name" else F.coalesce(e, F.lit(0).cast("long"))


def group_value(kind: str) -> Column:
    """The header under which a row stands in a grouped page."""
    at = F.timestamp_seconds("taken_at")
    return {
        "none": F.lit(""),
        "folder": F.col("folder_id").cast("string"),
        "day": F.date_format(at, "yyyy-MM-dd"),
        "month": F.date_format(at, "yyyy-MM"),
        "year": F.date_format(at, "yyyy"),
        "rating": F.col("rating").cast("string"),
        "camera": F.coalesce("cam_model", F.lit("")),
        "lens": F.coalesce(F.col("lens") if kind == "lens" else F.lit(None), F.lit("")),
        "filetype": F.lower("ext"),
        "culling": F.when(F.col("culling_flag") == 1, "keep").when(F.col("culling_flag") == 2, "drop").otherwise("open"),
    }[kind]


def page(c: Catalog, f: Filter, limit: int, cursor: tuple | None = None, group: str = "none") -> DataFrame:
    """A page of the listing from ``cursor`` (key, id) on, in the filter's sort order.

    ``limit + 1`` rows come back where there is a next page; the id breaks ties in the sort's own direction, so
    pages neither overlap nor leave a row out. The condition on the cursor reaches the scan.
    """
    k, i = sort_key(f), F.col("id")
    out = apply(c, f)
    if cursor is not None:
        v, last = F.lit(cursor[0]), F.lit(cursor[1])
        past = ((k < v) | ((k == v) & (i < last))) if f.descending else ((k > v) | ((k == v) & (i > last)))
        out = out.where(past)
    order = [k.desc(), i.desc()] if f.descending else [k.asc(), i.asc()]
    return out.withColumn("sort_key", k).withColumn("header", group_value(group)).orderBy(*order).limit(min(max(limit, 1), 500) + 1)


def page_rows(c: Catalog, f: Filter, limit: int, cursor: tuple | None = None) -> DataFrame:
    """A page with each row's folder (name, path, area) and whether a thumbnail is there; files without a folder are not listed.

    Folders and thumbnails are joined to the page's rows alone, at most 501 of them.
    """
    listed = Catalog(c.files.join(c.folders.select(F.col("id").alias("folder_id")).distinct(), "folder_id", "left_semi"), c.folders, c.thumbs, c.file_tags, c.nas_state, c.faces)
    rows = F.broadcast(page(listed, f, limit, cursor))
    fo = c.folders.select(F.col("id").alias("folder_id"), F.col("name").alias("folder"), "rel_path", "area")
    shown = c.thumbs.where("state = 1").select(F.col("file_id").alias("id"), F.lit(True).alias("__t"))
    with_thumb = shown.join(rows.select("id"), "id", "left_semi").distinct()
    order = [F.desc("sort_key"), F.desc("id")] if f.descending else ["sort_key", "id"]
    return rows.join(fo, "folder_id").join(with_thumb, "id", "left").withColumn("has_thumb", F.coalesce("__t", F.lit(False))).drop("__t").orderBy(*order)


def library_stats(c: Catalog, libraries: DataFrame) -> DataFrame:
    """Live files and bytes of each library, empty ones too, and how many have a thumbnail: ``library_id, files, bytes, thumbs_done, thumbs_pending``."""
    done = c.thumbs.where("state = 1").select(F.col("file_id").alias("id"), F.lit(1).alias("__t")).distinct()
    live = c.files.where("trashed_at is null").select("id", "folder_id", "size").join(done, "id", "left")
    # a row a folder before the folders are joined, so a hot folder is one row
    per = live.groupBy("folder_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count("__t").alias("thumbs_done"))
    lib = per.join(c.folders.select(F.col("id").alias("folder_id"), "library_id"), "folder_id").groupBy("library_id").agg(*(F.sum(x).alias(x) for x in ("files", "bytes", "thumbs_done")))
    got = libraries.select(F.col("id").alias("library_id")).distinct().join(lib, "library_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return got.select("library_id", *(zero(x).alias(x) for x in ("files", "bytes", "thumbs_done")), (zero("files") - zero("thumbs_done")).alias("thumbs_pending"))


def next_cursor(rows: list, limit: int) -> tuple | None:
    """The cursor of the next page, from collected rows of ``page``; None on the last one."""
    return (rows[limit - 1]["sort_key"], rows[limit - 1]["id"]) if len(rows) > limit else None


#: Rows that are sorted to find a place among them; more are first narrowed down by counts.
PLACE_ROWS, PLACE_BUCKETS = 200_000, 1024


def cursor_at(c: Catalog, f: Filter, ordinal: int, most: int = PLACE_ROWS) -> DataFrame:
    """The cursor after which row ``ordinal`` comes: one row ``sort_key, id``, or none at the ends.

    Rows are counted by ranges of the sort key (by beginnings of a name), the range that holds the place is
    counted again, and so on, by ids where a key repeats; only a range of ``most`` rows or fewer is ever sorted.
    """
    got = apply(c, f).select(sort_key(f).alias("sort_key"), "id")
    if ordinal <= 0:
        return got.limit(0)
    order = ["sort_key", "id"] if not f.descending else [F.desc("sort_key"), F.desc("id")]
    left, text, length = ordinal, f.sort == "name", 1
    while True:
        by, ends = ("sort_key", got.agg(F.count(F.lit(1)).alias("n"), F.min("sort_key").alias("lo"), F.max("sort_key").alias("hi")).first())
        if ends.n < left:
            return got.limit(0)
        if ends.n <= most:
            return got.orderBy(*order).offset(left - 1).limit(1)
        if ends.lo == ends.hi:
            by, ends = ("id", got.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).first())
            if ends.lo == ends.hi:
                return got.offset(left - 1).limit(1)
        if by == "sort_key" and text:
            bucket = F.substring("sort_key", 1, length)
            length += 1
        else:
            width = (int(ends.hi) - int(ends.lo)) // PLACE_BUCKETS + 1
            bucket = F.floor((F.col(by) - F.lit(ends.lo)) / width)
        counts = sorted(((r.b, r["count"]) for r in got.groupBy(bucket.alias("b")).count().collect()), reverse=f.descending)
        for b, n in counts:
            if left <= n:
                break
            left -= n
        got = got.where(bucket == b)


def by_ids(c: Catalog, ids: list[int]) -> DataFrame:
    """Rows in the caller's order; unknown ids are left out."""
    spark = c.files.sparkSession
    want = spark.createDataFrame(list(enumerate(ids)), "pos int, id long")
    return c.files.join(want, "id").orderBy("pos")


def summary(c: Catalog, f: Filter) -> DataFrame:
    return apply(c, f).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def timeline(c: Catalog, f: Filter) -> DataFrame:
    """Files a month, newest first."""
    m = F.date_format(F.timestamp_seconds("taken_at"), "yyyy-MM")
    got = apply(c, f).where("taken_at is not null").groupBy(m.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max("taken_at").alias("newest"))
    return got.select(F.substring("m", 1, 4).cast("int").alias("year"), F.substring("m", 6, 2).cast("int").alias("month"), "n", "newest").orderBy(F.desc("year"), F.desc("month"))


def grid_key(lat: Column, lon: Column) -> Column:
    """The 0.1-degree cell of a position, as its south-west corner in text."""
    a = (F.floor(F.round(lat * 10, 8) + 900) - 900) / 10 + F.lit(0.0)
    o = (F.floor(F.round(lon * 10, 8) + 1800) - 1800) / 10 + F.lit(0.0)
    return F.format_string("%.1f,%.1f", a, o)


def facet(c: Catalog, f: Filter, kind: str, limit: int = 200) -> DataFrame:
    """Values of a facet inside the filter: ``value, n``. Times and ratings come highest first, the rest by count."""
    at = F.timestamp_seconds("taken_at")
    value = {
        "year": F.date_format(at, "yyyy"),
        "day": F.date_format(at, "yyyy-MM-dd"),
        "camera": F.coalesce(F.nullif(F.col("cam_model"), F.lit("")), F.lit("")),
        "lens": F.coalesce(F.col("lens") if kind == "lens" else F.lit(None), F.lit("")),
        "rating": F.col("rating").cast("string"),
        "kind": F.col("kind").cast("string"),
        "place": F.when(valid_gps(), grid_key(F.col("gps_lat"), F.col("gps_lon"))).otherwise(F.lit("")),
        **{n: F.coalesce(F.col(n) if kind == n else F.lit(None), F.lit("")) for n in ("country", "admin1", "admin2")},
    }[kind]
    got = apply(c, f).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    order = [F.desc("value")] if kind in ("year", "day", "rating") else [F.desc("n"), F.asc("value")]
    return got.orderBy(*order).limit(limit)


def map_overview(c: Catalog, f: Filter) -> DataFrame:
    good = apply(c, f).where(valid_gps())
    return good.agg(F.count(F.lit(1)).alias("n"), F.min("gps_lat").alias("south"), F.min("gps_lon").alias("west"), F.max("gps_lat").alias("north"), F.max("gps_lon").alias("east"))


def map_cells(c: Catalog, f: Filter, precision: float, label: str | None = None, limit: int = 4000) -> DataFrame:
    """Cells of the map: position, count, newest id, and the most frequent label with their number.

    The largest ``limit`` cells come back; equal counts by cell, so the answer is the same each time.
    """
    p = min(max(precision, 1e-4), 10.0) if math.isfinite(precision) else 0.1
    good = apply(c, f).where(valid_gps())
    name = F.col(label) if label else F.lit(None).cast("string")
    keyed = good.select(F.floor((F.col("gps_lat") + 90) / p).alias("ky"), F.floor((F.col("gps_lon") + 180) / p).alias("kx"), "gps_lat", "gps_lon", "id", name.alias("label"))
    per = keyed.groupBy("ky", "kx", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("gps_lat").alias("a"), F.sum("gps_lon").alias("o"), F.max("id").alias("top"))
    # one row a cell and label: counts, sums and the mode come from the same pre-aggregation
    first = F.min(F.when(F.col("label").isNotNull(), F.struct((-F.col("k")).alias("k"), "label")))
    cells = per.groupBy("ky", "kx").agg(F.sum("k").alias("n"), (F.sum("a") / F.sum("k")).alias("lat"), (F.sum("o") / F.sum("k")).alias("lon"), F.max("top").alias("newest_id"), F.count("label").alias("labels"), first.alias("f"))
    return cells.select("ky", "kx", "n", "lat", "lon", "newest_id", "labels", F.col("f.label").alias("label")).orderBy(F.desc("n"), "ky", "kx").limit(limit)


def rule(text: str) -> Column:
    """A stored rule, a JSON list of ``field, op, value``, as the condition that all of them hold.

    Ops: eq, ne, lt, le, gt, ge, contains, starts, in. Text that can't be read, or an op that isn't known, matches nothing.
    """
    ops = {
        "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v,
        "contains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())), "starts": lambda c, v: F.startswith(F.lower(c), F.lit(str(v).lower())), "in": lambda c, v: c.isin(list(v)),
    }
    try:
        parts = json.loads(text)
        conds = [ops[p["op"]](F.col(p["field"]), p["value"]) for p in parts]
    except (ValueError, KeyError, TypeError):
        return F.lit(False)
    out = F.lit(True)
    for c in conds:
        out = out & F.coalesce(c, F.lit(False))
    return out


def visible(nodes: DataFrame, open_paths: DataFrame) -> DataFrame:
    """Nodes of a folder tree that show when only the paths of ``open_paths`` are open: all above them must be."""
    from silverfold.operators.trees import ancestors

    up = nodes.select("path", F.explode_outer(ancestors(F.col("path"), itself=False)).alias("up"))
    seen = up.join(open_paths.select(F.col("path").alias("up"), F.lit(True).alias("o")).distinct(), "up", "left")
    shut = seen.where("up is not null and o is null").select("path").distinct()
    return nodes.join(shut, "path", "left_anti")
