"""Names, times, fingerprints."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverfold.functions import content as k
from silverfold.functions import dates, names


def at(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())


@pytest.mark.parametrize(("name", "want"), [
    ("20260101_123456.jpg", at(2026, 1, 1, 12, 34, 56)), ("IMG_20240229_000001.jpg", at(2024, 2, 29, 0, 0, 1)), ("PXL_20260101_123456789.jpg", at(2026, 1, 1, 12, 34, 56)),
    ("2026-01-01 12.34.56.jpg", at(2026, 1, 1, 12, 34, 56)), ("20260101.jpg", at(2026, 1, 1)), ("2022_05_14 19_17.jpg", at(2022, 5, 14, 19, 17)), ("AH001_am_sm_210609_155304.jpg", at(2021, 6, 9, 15, 53, 4)),
    ("3_20260815_093012.jpg", at(2026, 8, 15, 9, 30, 12)), ("kakaotalk_1525225566458.mp4", 1525225566), ("FB_IMG_1525225566458123.jpg", 1525225566), ("IMG_1234.jpg", None), ("20261301_120000.jpg", None), ("99999999.jpg", None), ("", None), (None, None),
])
def test_times_in_names(name, want):
    assert dates.time_in_name(name) == want


def test_times(spark):
    now = at(2026, 1, 1)
    df = spark.createDataFrame([(5, None, at(2020, 1, 1), at(2019, 1, 1)), (at(2015, 1, 1), None, None, None), (None, at(2016, 1, 1), 7, None), (None, None, 7, None)], "e long, n long, m long, b long")
    got = [(r.x.taken_at, r.x.source) for r in df.select(dates.taken_at(F.col("e"), F.col("n"), F.col("m"), F.col("b"), now).alias("x")).collect()]
    assert got == [(at(2019, 1, 1), 2), (at(2015, 1, 1), 0), (at(2016, 1, 1), 1), (now, 3)]
    v = df.select(dates.video_taken_at([F.col("e"), F.col("m"), F.col("b")], now).alias("x")).collect()
    assert [(r.x.at, r.x.clue) if r.x else None for r in v] == [(at(2019, 1, 1), 2), (at(2015, 1, 1), 0), None, None]
    t = spark.createDataFrame([("2015:03:04 05:06:07", "2015-03-04T05:06:07+09:00", 0.004), ("0000:00:00 00:00:00", "never", 2.0), ("2015:13:04 05:06:07", None, 0.0), (None, None, None)], "x string, i string, s double")
    r = t.select(dates.exif_time(F.col("x")).alias("x"), dates.iso_time(F.col("i")).alias("i"), dates.shutter(F.col("s")).alias("s")).collect()
    assert [tuple(x) for x in r] == [(at(2015, 3, 4, 5, 6, 7), at(2015, 3, 3, 20, 6, 7), "1/250"), (None, None, "2.0s"), (None, None, None), (None, None, None)]


def test_folder_names(spark):
    cases = [("2003-02-08 Birthday", "2003-02-08", "Birthday"), ("2024.08.27 Jeju", "2024-08-27", "Jeju"), ("20240827_trip", "2024-08-27", "trip"), ("2024_08_27", "2024-08-27", ""), ("2024-08.27 x", None, "2024-08.27 x"), (" owl ", None, "owl"), ("", None, ""), (None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "name string")
    assert [(r.x.date, r.x.title) for r in df.select(names.parse_folder(F.col("name")).alias("x")).collect()] == [c[1:] for c in cases]


def test_titles(spark):
    df = spark.createDataFrame([("Coast trip 2일차",), ("Coast trip",), ("일차",), ("3일차",)], "t string")
    assert [r.n for r in df.select(names.next_day(F.col("t")).alias("n")).collect()] == ["Coast trip 3일차", "Coast trip 2일차", "일차 2일차", "3일차"]
    w = spark.createDataFrame([("Big trip-to (Jeju) 2024 a 2일차",)], "t string").select(names.words(F.col("t")).alias("w")).first().w
    assert w == ["Big", "trip", "to", "Jeju"]
    n = spark.createDataFrame([("a.jpg", 1), ("a.jpg", 2), ("a", 3), (".x", 2)], "n string, k int").select(names.numbered(F.col("n"), F.col("k")).alias("x")).collect()
    assert [r.x for r in n] == ["a.jpg", "a (2).jpg", "a (3)", ".x (2)"]
    d = spark.createDataFrame([(["a/b/c", "a/b/d/e", "a/bb"],), (["x"],), (["p/q", "p/q"],), (["m", "n"],)], "p array<string>").select(names.common_dir(F.col("p")).alias("d")).collect()
    assert [r.d for r in d] == ["a", "x", "p/q", ""]


def test_kinds(spark):
    df = spark.createDataFrame([("a.JPG",), ("b.cr2",), ("c.MOV",), ("._d.jpg",), (".e.jpg",), ("f.txt",), ("jpg",), ("",)], "n string")
    assert [r.k for r in df.select(names.kind_of(F.col("n")).alias("k")).collect()] == [0, 2, 1, None, None, None, None, None]
    df = spark.createDataFrame([("a/@eaDir/b",), ("a/.github/x",), ("a/b",), ("",)], "p string")
    assert [r.s for r in df.select(names.skipped(F.col("p")).alias("s")).collect()] == [True, True, False, False]


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def test_picture_hash_ignores_metadata():
    head, scan = b"\xff\xd8", b"\xff\xda\x00\x04ab\x01\x02\xff\x00\x03\xff\xd9"
    bare = head + segment(0xDB, b"table") + scan
    assert k.picture_hash(bare) == hashlib.sha256(bare).hexdigest()
    assert k.picture_hash(head + segment(0xE1, b"exif" * 20) + segment(0xFE, b"note") + segment(0xDB, b"table") + scan + b"tail") == k.picture_hash(bare)
    assert k.picture_hash(head + segment(0xDB, b"other") + scan) != k.picture_hash(bare)
    assert [k.picture_hash(x) for x in (b"", b"GIF89a", head, head + b"\xff\xdb\x00\x01", head + b"\xff\x00", head + b"\xff\xdb\x40\x00x")] == [None] * 6


def test_quick_hash_sees_both_ends_and_the_length():
    a = bytes(200_000)
    assert k.quick_hash(a) != k.quick_hash(a + b"\0")
    assert k.quick_hash(a) == k.quick_hash(a[:100_000] + b"x" + a[100_001:])
    assert k.quick_hash(a) != k.quick_hash(a[:-1] + b"x") and len(k.quick_hash(b"")) == 16


def test_perceptual_hash_of_the_shared_picture(spark):
    y, x = np.mgrid[0:32, 0:32]
    gray = ((7 * x + 13 * y + (x * y) % 11) * 3) % 256
    assert k.perceptual_hash(gray) == 0xAD424C63BD939D23
    df = spark.createDataFrame([(bytes(gray.astype(np.uint8).ravel().tolist()),), (b"x",), (None,)], "g binary")
    got = [r.h for r in df.select(k.perceptual_hash_of(F.col("g")).alias("h")).collect()]
    assert got == [0xAD424C63BD939D23 - (1 << 64), None, None]


def test_signatures():
    gray, rgb = np.full((32, 32), 40, np.uint8), np.full((8, 8, 3), 40, np.uint8)
    a = k.signature(gray, rgb)
    assert len(a) == 385 and set(a[1:257]) == {40} and set(a[257:]) == {128}
    assert k.alike(a, k.signature(gray + 3, rgb)) and not k.alike(a, k.signature(gray + 4, rgb))
    red = rgb.copy()
    red[..., 0] = 90
    assert not k.alike(a, k.signature(gray, red)) and not k.alike(a, a[:-1]) and not k.alike(None, a) and not k.alike(b"\2" + a[1:], a)


def test_histogram_and_keys(spark):
    h = k.histogram(np.array([[[0, 1, 2], [255, 254, 253], [9, 9, 9], [9, 9, 9]]], np.uint8))
    assert h["peak"] == 2 and h["shadows"] == 0.25 and h["lights"] == 0.25 and h["counts"].sum() == 12
    assert k.histogram(np.empty((0, 0, 3), np.uint8))["peak"] == 1
    assert k.cache_key("a", 1, 2) != k.cache_key("a", 2, 1) and len(k.cache_key("", 0, 0)) == 16
    blob = np.array([1.5, -2.0], "<f4").tobytes()
    assert spark.createDataFrame([(blob,), (None,)], "b binary").select(k.floats_of(F.col("b")).alias("f")).collect()[0].f == [1.5, -2.0]
