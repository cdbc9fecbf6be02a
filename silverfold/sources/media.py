"""Reading folders of media and reference files, and writing sidecars and snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverfold.functions.names import kind_of, skipped
from silverfold.operators.diff import nfc

REGION = "code string, name string, level int, parent_code string, bbox array<double>, polys array<array<array<array<double>>>>"


def walk(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """Media files below a folder: ``rel_path, dir, name, kind, size, modified_at`` (and ``content``).

    Hidden files and folders that are never scanned are left out; names are in NFC. The
    listing alone is read unless the content is asked for.
    """
    root = folder.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    tail = nfc(F.url_decode(F.regexp_replace(F.expr(f"substring(path, instr(path, '{root}') + {len(root)})"), r"\+", "%2B")))
    got = raw.select(tail.alias("rel_path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_at"), *(["content"] if content else []))
    got = got.withColumn("name", F.substring_index("rel_path", "/", -1)).withColumn("dir", F.regexp_replace("rel_path", "/?[^/]*$", "")).withColumn("kind", kind_of(F.col("name")))
    return got.where("kind is not null").where(~skipped(F.col("dir")))


def cities(spark: SparkSession, path: str) -> DataFrame:
    """Cities from tab-separated text; comment lines, broken rows and positions out of range are left out."""
    schema = "lat double, lon double, name string, cc string, admin1_code string, admin1_name string, admin2_name string, population long, name_ko string"
    got = spark.read.csv(path, sep="\t", comment="#", schema=schema, mode="DROPMALFORMED", quote="")
    return got.where("lat between -90 and 90 and lon between -180 and 180 and name is not null")


def countries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema="cc string, name string, name_en string", mode="DROPMALFORMED", quote="").where("length(cc) = 2")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions with their boxes and polygons from JSON."""
    return spark.read.json(path, schema=REGION, multiLine=True).where("code is not null")


def preferred_names(names: DataFrame, key: str) -> DataFrame:
    """One name a key: a preferred one, then the shorter, then by letter. ``names`` has ``key, name, preferred``."""
    best = F.min(F.struct((~F.coalesce("preferred", F.lit(False))).alias("a"), F.char_length("name").alias("b"), "name"))
    return names.where("name is not null").groupBy(key).agg(best.alias("x")).select(key, F.col("x.name").alias("name"))


def _xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sidecars(files: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """XMP of files with a mark: ``id, name, xmp``. ``tags`` has ``file_id, tag``.

    A file with neither rating, flag, favourite nor tag has none.
    """
    f = files
    if tags is not None:
        t = tags.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        f = f.join(t, "id", "left")
    else:
        f = f.withColumn("tags", F.lit(None).cast("array<string>"))
    marked = f.where("rating > 0 or culling_flag > 0 or favorite or size(tags) > 0")
    rating = F.when(F.col("culling_flag") == 2, -1).otherwise(F.col("rating"))
    label = F.when(F.col("favorite"), F.lit(' xmp:Label="favorite"')).otherwise(F.lit(""))
    bag = F.when(F.size("tags") > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<rdf:li>"), _xml(t), F.lit("</rdf:li>"))), ""), F.lit("</rdf:Bag></dc:subject>"))).otherwise(F.lit(""))
    xmp = F.concat(
        F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmp:Rating="'),
        rating.cast("string"), F.lit('"'), label, F.lit(">"), bag, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"),
    )
    return marked.select("id", "name", xmp.alias("xmp"))


def write_sidecars(df: DataFrame, folder: str) -> None:
    """Sidecars as lines of JSON, in parts; one file a row would be a small-files storm."""
    df.write.mode("overwrite").json(folder)


def snapshot(df: DataFrame, folder: str, version: str) -> str:
    """A dated copy of a table."""
    path = f"{folder}/{version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The snapshots of a folder, oldest first; a folder that isn't there has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def restore(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The table of a snapshot, the newest where none is named; without one it raises."""
    found = versions(spark, folder)
    if version is None and found:
        version = found[-1]
    if version not in found:
        raise ValueError(f"no snapshot {version} in {folder}")
    return spark.read.parquet(f"{folder}/{version}")


def snapshot_due(found: list[str], now: int, hours: int = 24) -> bool:
    """Whether the newest snapshot, versions being unix seconds in text, is older than ``hours``."""
    return not found or now - int(max(found, key=int)) >= hours * 3600


def prune_snapshots(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Drops all snapshots but the newest ``keep`` (1 or more) and returns those dropped."""
    gone = old_snapshots(versions(spark, folder), max(keep, 1))
    for v in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{v}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def old_snapshots(versions: list[str], keep: int) -> list[str]:
    """The versions to drop when the newest ``keep`` stay."""
    return sorted(versions)[:-keep] if keep else sorted(versions)


def transfer_stats(text: Column) -> Column:
    """Numbers out of the statistics a file transfer prints: files, sent files, bytes."""
    n = lambda p: F.replace(F.regexp_extract(text, p, 1), F.lit(","), F.lit(""))
    num = lambda p: F.try_to_number(F.nullif(n(p), F.lit("")), F.lit("9" * 18)).cast("long")
    return F.struct(num(r"Number of files: ([\d,]+)").alias("files"), num(r"Number of (?:regular )?files transferred: ([\d,]+)").alias("sent"), num(r"Total transferred file size: ([\d,]+)").alias("bytes"))


def transfer_progress(text: Column) -> Column:
    """Bytes, percent and rate text out of a progress line such as ``1,234  56%  7.89MB/s  0:00:10``; null for other lines."""
    p = r"^\s*([\d,]+)\s+(\d+)%\s+(\S+/s)\s"
    n = F.replace(F.regexp_extract(text, p, 1), F.lit(","), F.lit(""))
    return F.when(text.rlike(p), F.struct(n.cast("long").alias("bytes"), F.regexp_extract(text, p, 2).cast("int").alias("percent"), F.regexp_extract(text, p, 3).alias("rate")))


#: Seconds from the first of 1904, from which the container's times count, to that of 1970 (fixed value).
CONTAINER_EPOCH = 2_082_844_800


def _boxes(data: bytes, at: int, end: int):
    """Boxes ``kind, start, end`` of their content, one after the other; a box that doesn't fit ends the walk."""
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def container_seconds(data: bytes | None) -> int | None:
    """When a video was taken, by its container: the creation time of the movie header, unix seconds, or None.

    Walks the boxes of the file to ``moov`` and its ``mvhd``; version 1 has times of 64 bits, and 0 is no time.
    """
    for kind, a, b in _boxes(data or b"", 0, len(data or b"")):
        if kind == b"moov":
            for inner, c, d in _boxes(data, a, b):
                if inner == b"mvhd" and d - c >= 12:
                    long = data[c] == 1
                    t = int.from_bytes(data[c + 4 : c + (12 if long else 8)], "big")
                    return t - CONTAINER_EPOCH if t else None
    return None


#: Tags of an EXIF block by number, and of its positions (fixed values).
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x9003: "taken", 0x8827: "iso", 0xA434: "lens"}
EXIF_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
EXIF_SUB, EXIF_GPS_AT = 0x8769, 0x8825
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(d: bytes, at: int, order: str) -> dict[int, object]:
    """Entries of one directory of a TIFF block: texts, numbers, and rationals as floats."""
    num = lambda a, n: int.from_bytes(d[a : a + n], order)
    out: dict[int, object] = {}
    if at <= 0 or at + 2 > len(d):
        return out
    for i in range(num(at, 2)):
        e = at + 2 + 12 * i
        if e + 12 > len(d):
            break
        tag, kind, n = num(e, 2), num(e + 2, 2), num(e + 4, 4)
        size = _SIZES.get(kind, 0) * n
        a = e + 8 if size <= 4 else num(e + 8, 4)
        if not size or a + size > len(d):
            continue
        if kind == 2:
            out[tag] = d[a : a + n].split(b"\0")[0].decode("utf-8", "replace").strip() or None
        elif kind == 5:
            parts = [(num(a + 8 * k, 4), num(a + 8 * k + 4, 4)) for k in range(n)]
            out[tag] = [x / y if y else None for x, y in parts]
        else:
            out[tag] = num(a, _SIZES[kind])
    return out


def exif_fields(data: bytes | None) -> dict:
    """Camera, lens, ISO, time text and position out of a JPEG's EXIF segment; what is missing or broken is None.

    South and west are negative, and so is a height below the sea.
    """
    out = dict.fromkeys((*EXIF_TAGS.values(), "lat", "lon", "alt"))
    data, at, tiff = data or b"", 2, None
    while at + 4 <= len(data) and data[:2] == b"\xff\xd8" and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            tiff = data[at + 10 : at + 2 + size]
            break
        at += 2 + size
    if not tiff or tiff[:2] not in (b"II", b"MM"):
        return out
    order = "little" if tiff[:2] == b"II" else "big"
    main = _directory(tiff, int.from_bytes(tiff[4:8], order), order)
    sub = _directory(tiff, int(main.get(EXIF_SUB) or 0), order)
    for tag, name in EXIF_TAGS.items():
        out[name] = main.get(tag, sub.get(tag))
    gps = {EXIF_GPS[k]: v for k, v in _directory(tiff, int(main.get(EXIF_GPS_AT) or 0), order).items() if k in EXIF_GPS}
    for name, far in (("lat", "S"), ("lon", "W")):
        v = gps.get(name)
        if isinstance(v, list) and len(v) == 3 and None not in v:
            out[name] = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if gps.get(f"{name}_ref") == far else 1)
    if isinstance(gps.get("alt"), list) and gps["alt"][0] is not None:
        out["alt"] = gps["alt"][0] * (-1 if gps.get("alt_ref") == 1 else 1)
    return out


@F.pandas_udf(T.LongType())
def container_time(content: pd.Series) -> pd.Series:
    """:func:`container_seconds` of a column of file contents."""
    return content.map(container_seconds).astype("Int64")


EXIF_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("make", "model", "taken")] + [T.StructField("iso", T.LongType()), T.StructField("lens", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in ("lat", "lon", "alt")])


@F.pandas_udf(EXIF_TYPE)
def exif_of(content: pd.Series) -> pd.DataFrame:
    """:func:`exif_fields` of a column of file contents."""
    got = pd.DataFrame([exif_fields(c) for c in content], columns=EXIF_TYPE.names).astype(object)
    return got.assign(iso=got["iso"].astype("Int64"), **{c: got[c].astype("Float64") for c in ("lat", "lon", "alt")})
