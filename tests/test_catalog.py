"""The read model on the seed of fifty files, and every query over the smallest tables."""

import pytest
from pyspark.sql import functions as F

from silverfold.operators import catalog as c

SCHEMA = "id long, folder_id long, name string, size long, kind int, taken_at long, rating int, culling_flag int, favorite boolean, created_at long, modified_at long, width long, height long, duration_ms long, cam_model string, lens string, ext string, gps_lat double, gps_lon double, country string, admin1 string, admin2 string, trashed_at long"


def seed(spark, gps=None):
    gps = gps or {}
    rows = [
        (i, 1 if i <= 30 else 2 if i <= 40 else 3, f"IMG_{i:04d}.jpg", 100 * i, 1 if i % 10 == 0 else 0, 1_000_000 + i // 5 * 100, i % 6, 2 if i % 7 == 0 else 0, i % 11 == 0,
         None if i % 3 else i, None if i % 2 else 5 * i, i % 4 or None, 7, None, None if i % 5 else "", None, "jpg", *gps.get(i, (None, None)), None, None, None, None)
        for i in range(1, 51)
    ]
    folders = spark.createDataFrame([(1, "V", "a", 1, None), (2, "V", "a/b", 1, 9), (3, "V", "z", 2, 9), (4, "V", "p_q", 0, None), (5, "V", "pXq", 0, None)], "id long, volume_uuid string, rel_path string, area int, library_id long")
    tags = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(i, 2) for i in range(4, 7)], "file_id long, tag_id long")
    thumbs = spark.createDataFrame([(1, 1), (2, 0)], "file_id long, state int")
    return c.Catalog(spark.createDataFrame(rows, SCHEMA), folders, thumbs=thumbs, file_tags=tags, nas_state=thumbs.select("file_id"), faces=tags.withColumnRenamed("tag_id", "person_id"))


@pytest.mark.parametrize("sort", ["taken", "pixels", "name"])
@pytest.mark.parametrize("descending", [True, False])
def test_pages_cover_everything_once(spark, sort, descending):
    k, f, seen, cursor = seed(spark), c.Filter(sort=sort, descending=descending), [], None
    k.files = k.files.cache()
    while True:
        rows = c.page(k, f, 13, cursor).collect()
        seen += [r.id for r in rows[:13]]
        cursor = c.next_cursor(rows, 13)
        if cursor is None:
            break
    assert len(seen) == 50 and set(seen) == set(range(1, 51))
    at = c.cursor_at(k, f, 26).collect()[0]
    assert at.id == seen[25] and c.cursor_at(k, f, 0).count() == 0 and c.cursor_at(k, f, 51).count() == 0


def n(k, **f):
    return c.apply(k, c.Filter(**f)).count()


def test_filters(spark):
    k = seed(spark, {1: (37.55, 126.98), 2: (0.0, 0.0), 3: (0.05, 0.05), 4: (-0.05, -0.05), 5: (90.1, 0.0)})
    assert (n(k), n(k, folder_path="a"), n(k, folder_path="A/B"), n(k, folder_path="a/bb"), n(k, folder_path="")) == (50, 40, 10, 0, 50)
    assert (n(k, folder_path="p_q"), n(k, folder_id=1), n(k, folder_id=2), n(k, area=2), n(k, library_id=9)) == (0, 40, 10, 10, 20)
    assert (n(k, tag_id=1), n(k, tag_id=2), n(k, tag_id=77), n(k, person_id=1)) == (5, 3, 0, 5)
    assert (n(k, no_thumb=True), n(k, nas=True), n(k, nas=False)) == (49, 2, 48)
    assert (n(k, kind=1), n(k, min_rating=4), n(k, culling_flag=2), n(k, favorite_only=True), n(k, trashed=True)) == (5, 16, 7, 4, 0)
    assert (n(k, year="1970"), n(k, month="1970-01"), n(k, day="1970-01-12"), n(k, year="1971"), n(k, year="odd")) == (50, 50, 50, 0, 0)
    assert (n(k, camera=""), n(k, lens=""), n(k, country=""), n(k, country="KR")) == (50, 50, 50, 0)
    assert (n(k, place=""), n(k, place="0.0,0.0"), n(k, place="-0.1,-0.1"), n(k, place="nowhere")) == (47, 1, 1, 50)
    assert (n(k, bbox="30,120,40,130"), n(k, bbox="40,120,30,130"), n(k, bbox="1,2,3"), n(k, name_like="img_001"), n(k, name_like="%")) == (1, 50, 50, 10, 0)
    with pytest.raises(ValueError):
        n(c.Catalog(k.files, k.folders), tag_id=1)


def test_facets_agree_with_their_filters(spark):
    k = seed(spark, {1: (37.55, 126.98), 2: (37.51, 126.91), 3: (0.05, 0.05), 4: (-0.05, -0.05)})
    for kind, field in (("place", "place"), ("camera", "camera"), ("year", "year")):
        for r in c.facet(k, c.Filter(), kind).collect():
            assert n(k, **{field: r.value}) == r.n
    assert [tuple(r) for r in c.facet(k, c.Filter(kind=1), "kind").collect()] == [("1", 5)]
    assert c.timeline(k, c.Filter()).agg(F.sum("n")).first()[0] == 50
    assert c.map_overview(k, c.Filter()).first().n == 4
    assert [r.n for r in c.map_cells(k, c.Filter(), 1.0, label="cam_model").collect()] == [2, 1, 1]


def test_stored_filters():
    assert c.Filter.from_json("{}") == c.Filter()
    assert c.Filter.from_json('{"kind": 1, "gone": 2, "area": null}') == c.Filter(kind=1)
    assert c.Filter.from_json("{oops") is None and c.Filter.from_json(None) is None and c.Filter.from_json("[1]") is None
    assert c.parse_bbox("1,2,3,4") == (1, 2, 3, 4)
    assert c.parse_bbox("nan,2,3,4") is None and c.parse_bbox("1,2,3,400") is None


def test_ids_keep_their_order(spark):
    assert [r.id for r in c.by_ids(seed(spark), [9, 3, 999, 20]).collect()] == [9, 3, 20]


def test_the_page_is_a_top_k_and_the_filter_is_pushed(spark, tmp_path):
    k = seed(spark)
    k.files.write.parquet(str(tmp_path / "f"))
    k.files = spark.read.parquet(str(tmp_path / "f"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = c.page(k, c.Filter(kind=0, year="1970"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(kind,0)" in plan and "GreaterThanOrEqual(taken_at" in plan and "Join" not in plan
