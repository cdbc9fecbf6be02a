"""Names of folders and files: dates and titles, day counters, words, free names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ending of a title that counts the days of an event (fixed value).
DAY_MARK = "일차"
_SEPARATED = r"^(\d{4})([-._])(\d{2})\2(\d{2})"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})"

#: Extensions by kind and folders never scanned (fixed values).
IMAGE = ["jpg", "jpeg", "png", "heic", "heif", "gif", "bmp", "tif", "tiff", "webp", "avif", "jxl"]
RAW = ["cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "rw2", "raf", "pef", "raw", "3fr", "erf", "kdc", "mos", "mrw", "x3f"]
VIDEO = ["mp4", "mov", "m4v", "avi", "mkv", "3gp", "mts", "m2ts", "wmv", "flv", "webm", "mpg", "mpeg"]
SKIPPED = ["@eaDir", "#recycle", "#trash", ".Spotlight-V100", ".fseventsd", ".TemporaryItems", ".DocumentRevisions-V100", ".Trashes", ".DS_Store", "$RECYCLE.BIN", "System Volume Information", ".rsync-partial", ".SynologyWorkingDirectory"]


def kind_of(name: Column) -> Column:
    """0 image, 1 video, 2 raw by extension; null for hidden and other files."""
    ext = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1)))
    return F.when(F.startswith(name, F.lit(".")), None).when(ext.isin(RAW), 2).when(ext.isin(IMAGE), 0).when(ext.isin(VIDEO), 1)


def skipped(path: Column, also: list[str] = []) -> Column:
    """Whether a segment of the path is a folder that is never scanned."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(SKIPPED + also) | F.startswith(p, F.lit(".git")))


def _title(rest: Column) -> Column:
    return F.trim(F.regexp_replace(rest, r"^[ _\-.~]+", ""))


def parse_folder(name: Column) -> Column:
    """Date and title of a folder name such as ``2003-02-08 Title``, ``2024.08.27 Title`` or ``20240827_Title``."""
    date = lambda p, d, m: F.concat_ws("-", F.regexp_extract(name, p, 1), F.regexp_extract(name, p, m), F.regexp_extract(name, p, d))
    sep, compact = name.rlike(_SEPARATED), name.rlike(_COMPACT)
    return F.struct(
        F.when(sep, date(_SEPARATED, 4, 3)).when(compact, date(_COMPACT, 3, 2)).alias("date"),
        F.when(sep, _title(F.regexp_replace(name, _SEPARATED, ""))).when(compact, _title(F.regexp_replace(name, _COMPACT, ""))).otherwise(F.trim(name)).alias("title"),
    )


def split_day(title: Column) -> Column:
    """The title without its day counter, and the counter (null without one)."""
    t = F.rtrim(title)
    p = rf"^(.*?)\s*([0-9]+){DAY_MARK}$"
    has = t.rlike(rf"[0-9]{DAY_MARK}$")
    return F.struct(F.when(has, F.rtrim(F.regexp_extract(t, p, 1))).otherwise(t).alias("head"), F.when(has, F.regexp_extract(t, p, 2).cast("int")).alias("day"))


def next_day(title: Column) -> Column:
    s = split_day(title)
    return F.when(s["head"] == "", title).otherwise(F.concat(s["head"], F.lit(" "), (F.coalesce(s["day"], F.lit(1)) + 1).cast("string"), F.lit(DAY_MARK)))


def words(title: Column) -> Column:
    """Words of a title of two letters and more, without numbers and day counters."""
    return F.filter(F.split(title, r"[\s\-_,()]+"), lambda w: (F.char_length(w) >= 2) & ~w.rlike(r"^[0-9]+$") & ~F.endswith(w, F.lit(DAY_MARK)))


def safe_name(name: Column) -> Column:
    """A folder name without the separators of paths."""
    return F.trim(F.translate(name, "/\\:", "---"))


def event_dir(date: Column, title: Column, area: Column) -> Column:
    """Where an event's pictures go: ``year/date title``; without the year in area 1."""
    leaf = F.concat_ws(" ", date, safe_name(title))
    return F.when(area == 1, leaf).otherwise(F.concat_ws("/", F.substring(date, 1, 4), leaf))


#: A stem that already bears a number, as :func:`numbered` writes it.
NUMBERED = r"^(.+) \(([1-9]\d{0,8})\)$"


def split_name(name: Column) -> tuple[Column, Column]:
    """Stem and extension of a name; the extension is null where there is none."""
    dot = name.rlike(r"^.+\.[^.]+$")
    return F.when(dot, F.regexp_extract(name, r"^(.+)\.([^.]+)$", 1)).otherwise(name), F.when(dot, F.regexp_extract(name, r"^(.+)\.([^.]+)$", 2))


def numbered(name: Column, n: Column) -> Column:
    """A name with its number: the name itself for 1 or less, else ``name (n).ext``."""
    stem, ext = split_name(name)
    tag = F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
    return F.when(n <= 1, name).otherwise(F.concat(stem, tag, F.coalesce(F.concat(F.lit("."), ext), F.lit(""))))


def common_dir(paths: Column) -> Column:
    """The folder all paths of an array have in common, by whole segments."""
    split = F.transform(paths, lambda p: F.split(p, "/"))
    fold = F.aggregate(
        F.slice(split, 2, 1_000_000), F.get(split, F.lit(0)),
        lambda acc, p: F.slice(acc, 1, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(acc), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(acc, i - 1) == F.get(p, i - 1)), i).otherwise(n))),
    )
    return F.array_join(fold, "/")
