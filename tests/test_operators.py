"""Grouping, trees, places, vectors, plans and streams on small seeds."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silverfold.functions import content
from silverfold.operators import cull, ledger, places, trees, vectors
from silverfold.operators.unionfind import union_find
from silverfold.sources import media
from silverfold.streaming import watch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# bursts


def burst(spark, data, gap=10):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data, 1)], "id long, folder_id long, taken_at long, size long, sharpness double")
    return [(r.n, r.best_id, r.gain) for r in cull.bursts(df, gap).orderBy("start_at").collect()]


def test_bursts(spark):
    at = lambda *ts, f=1: [(f, t, 100, None) for t in ts]
    assert burst(spark, at(1000, 1003, 1005, 5000)) == [(3, 3, 200)]
    assert burst(spark, at(1000, 1002)) == []
    assert burst(spark, at(1000, 1002) + at(1001, 1003, f=2)) == []
    assert [b[0] for b in burst(spark, at(*range(1000, 1030, 3)))] == [10]
    assert burst(spark, [(1, 1000, 9, 10.0), (1, 1001, 9, 90.0), (1, 1002, 9, 50.0)]) == [(3, 2, 18)]
    assert burst(spark, [(1, 1000, 100, None), (1, 1001, 900, None), (1, 1002, 300, None)]) == [(3, 2, 400)]
    assert burst(spark, at(1000, 1020, 1040)) == [] and len(burst(spark, at(1000, 1020, 1040), 30)) == 1
    assert burst(spark, at(*range(1000, 1061))) == [] and burst(spark, at(*range(1000, 1060)))[0][0] == 60
    assert burst(spark, at(86395, 86398, 86401, 86404))[0][0] == 4
    assert burst(spark, at()) == []


# duplicates


def test_exact_groups(spark):
    data = [(1, 10, "x", 0, 50, 0), (2, 10, "x", 1, 60, 0), (3, 10, "y", 0, 1, 0), (4, 20, "z", 0, 9, 1), (5, 20, "z", 0, 1, 2), (6, 0, "e", 0, 1, 0), (7, 0, "e", 0, 1, 0), (8, 30, None, 0, 1, 0), (9, 30, None, 0, 1, 0)]
    df = spark.createDataFrame(data, "id long, size long, hash string, area int, taken_at long, culling_flag int")
    assert rows(cull.exact_groups(df, "hash")) == [(10, "x", 2, 2, 10, False), (20, "z", 2, 4, 20, True)]
    assert cull.exact_groups(df.limit(0), "hash").count() == 0


def test_twins_need_a_different_size_nearby(spark):
    df = spark.createDataFrame([(1, "a", 100.0), (2, "a", 101.0), (3, "a", 101.0), (4, "a", 300.0), (5, "b", 100.0), (6, None, 100.0)], "id long, k string, size double")
    assert rows(cull.twins(df, ["k"], "size", 1.0).select("id")) == [(1,), (2,), (3,)]


def test_junk(spark):
    df = spark.createDataFrame([("Screenshot_1.png", "a", 9, None), ("x.png", "my/Screenshots", 9, None), ("KakaoTalk_1.jpg", "Downloads", 9**6, None), ("a.jpg", "x/Downloads/y", 9**6, 900), ("a.jpg", "myDownloads", 61439, 400), ("a.jpg", "", 61439, 401), ("a.jpg", None, 0, None), ("a.jpg", "p", 61440, 10)], "n string, d string, s long, w long")
    got = [r.r for r in df.select(cull.junk_reason(*(F.col(c) for c in "ndsw")).alias("r")).collect()]
    assert got == ["screenshot", "screenshot", "messenger", "downloaded", "too_small", None, None, None]


def test_near_groups(spark):
    base = 0x0F0F00FF12345678
    data = [(1, 1, base, 10, 100, 50, 0), (2, 2, base ^ 3, 90, 50, 25, 0), (3, 3, base ^ 3, 5, 50, 40, 0), (4, 4, base ^ 0xFF0000, 5, 100, 50, 0), (5, 9, 77, 5, 40, 40, 0), (6, 9, 76, 5, 40, 40, 0), (7, 1, None, 1, 1, 1, 0), (8, 5, base, 10, 100, 50, 1)]
    df = spark.createDataFrame(data, "file_id long, folder_id long, hash long, size long, width long, height long, area int")
    assert rows(cull.near_groups(df, 4)) == [(1, 3, 8, 100)]
    assert cull.near_groups(df.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        cull.hamming_pairs(df, "hash", 9)


def _near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("distance,crowd", [(1, 500), (4, 500), (4, 40), (8, 500)])
def test_hamming_pairs_lose_none(spark, monkeypatch, distance, crowd):
    # random hashes, families a few bits apart, and a crowd that shares most of its bits
    monkeypatch.setattr(cull, "KEY_HASHES", crowd)
    rng = random.Random(distance)
    hs = [rng.getrandbits(64) for _ in range(150)]
    hs += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for h in hs[:60] for _ in range(2)]
    hs += [rng.getrandbits(14) << rng.choice([0, 40]) for _ in range(200)] + [0, 2**64 - 1, 2**63]
    signed = sorted({h - (1 << 64) if h >> 63 else h for h in hs})
    df = spark.createDataFrame([(h,) for h in signed + signed[:20] + [None]], "hash long")
    want = sorted((a, b, _near(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if _near(a, b) <= distance)
    assert sorted(tuple(r) for r in cull.hamming_pairs(df, "hash", distance).collect()) == want


def test_near_groups_as_by_hand(spark):
    """Against going through all pictures: linked where hashes are near and pictures alike, split around seeds, bursts left out."""
    rng = random.Random(8)
    flat = lambda v: bytes([1]) + bytes([v]) * 384
    bases = [rng.getrandbits(63) for _ in range(12)]
    data = []
    for i in range(160):
        h = rng.choice(bases) ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(0, 4)))
        w, ht = rng.choice([(100, 50), (50, 25), (60, 40), (30, 20)])
        data.append((i, rng.randrange(3), h, rng.randrange(9), w, ht, rng.randrange(3), rng.choice([flat(10), flat(10), flat(12), flat(15), flat(90), b"x", None])))
    df = spark.createDataFrame(data, "file_id long, folder_id long, hash long, size long, width long, height long, area int, psig binary")
    skip = {3, 8, 20}
    there = [r for r in data if r[7] is not None and r[0] not in skip]
    link = lambda a, b: _near(a[2], b[2]) <= 4 and content.alike(a[7], b[7])
    part = {r[0]: r[0] for r in there}
    for _ in there:
        for a in there:
            for b in there:
                if link(a, b):
                    part[a[0]] = part[b[0]] = min(part[a[0]], part[b[0]])
    want, used = [], set()
    for a in sorted(there, key=lambda r: (-r[4] * r[5], r[0])):
        if a[0] in used:
            continue
        mine = [b for b in there if b[0] not in used and part[b[0]] == part[a[0]] and (b is a or content.alike(a[7], b[7]) and abs(b[4] / b[5] - a[4] / a[5]) <= 0.02 * a[4] / a[5])]
        mine = [b for b in mine if b is a or (-b[4] * b[5], b[0]) > (-a[4] * a[5], a[0])]
        used |= {b[0] for b in mine}
        if len(mine) > 1 and len({(b[1], b[4], b[5]) for b in mine}) > 1:
            best = max(mine, key=lambda b: (b[4] * b[5], b[6] in (1, 2), b[3], b[0]))
            want.append((len(mine), best[0], sum(b[3] for b in mine) - best[3]))
    got = cull.near_groups(df, 4, signature="psig", skip=spark.createDataFrame([(i,) for i in skip], "file_id long"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want) and len(want) > 5


def test_labels_of_long_chains(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (100, 102)], "a long, b long")
    got = dict(tuple(r) for r in cull.labels(e).collect())
    assert all(got[i] == 0 for i in range(61)) and [got[i] for i in (100, 101, 102)] == [100] * 3


def unit(c):
    return [float(c), float(np.sqrt(1 - c * c)), 0.0]


def test_scenes(spark):
    make = lambda data: spark.createDataFrame([(i, t, 100, s, v, 0) for i, t, s, v in data], "id long, taken_at long, size long, sharpness double, embedding array<double>, area int")
    got = cull.scenes(make([(1, 1000, 1.0, unit(1)), (2, 1300, 9.0, unit(0.97)), (3, 1600, 1.0, [0.0, 0.0, 1.0])])).collect()
    assert [(r.n, r.best_id, r.gain) for r in got] == [(2, 2, 100)]
    assert cull.scenes(make([(1, 1000, 1.0, unit(1)), (2, 5000, 9.0, unit(1))])).count() == 0
    chain = [(1, 1000, 1.0, unit(1)), (2, 1100, 1.0, unit(0.96)), (3, 1200, 1.0, unit(0.85))]
    assert [r.n for r in cull.scenes(make(chain)).collect()] == [2]


def test_scenes_as_by_hand(spark):
    """Against going through all pictures in turn; small blocks, ties in time, other dimensions, groups of other scans."""
    rng = random.Random(9)
    data = []
    for i in range(220):
        v = unit(rng.choice([1, 0.97, 0.94, 0.5, -1])) if rng.random() > 0.05 else [1.0]
        data.append((i, rng.choice([1000, 1000, 1500, 4000, 9000, 20000]) + rng.randrange(40) * 60, rng.randrange(1, 9), rng.choice([None, 0.5, 2.0]), v, rng.randrange(3)))
    data.append((900, 0, 1, None, unit(1), 0))
    df = spark.createDataFrame(data + [(901, None, 1, None, unit(1), 0), (902, 5, 1, None, None, 0)], "id long, taken_at long, size long, sharpness double, embedding array<double>, area int")
    grouped = [(i, i // 3) for i in range(60)]
    there = sorted((r for r in data if len(r[4]) == 3), key=lambda r: (r[1], r[0]))
    in_group = dict(grouped)
    seed: dict = {}
    for i, a in enumerate(there):
        if a[0] in seed:
            continue
        for b in there[i + 1 : i + 9]:
            together = a[0] in in_group and in_group[a[0]] == in_group.get(b[0])
            if b[1] - a[1] <= 3600 and b[0] not in seed and not together and float(np.dot(a[4], b[4])) >= 0.95:
                seed[b[0]] = seed[a[0]] = a[0]
    groups: dict = {}
    for r in there:
        if r[0] in seed:
            groups.setdefault(seed[r[0]], []).append(r)
    best = {s: max(g, key=lambda r: (r[5] in (1, 2), r[3] or 0.0, r[2], r[0])) for s, g in groups.items()}
    want = sorted((s, len(g), best[s][0], sum(r[2] for r in g) - best[s][2]) for s, g in groups.items())
    got = cull.scenes(df, ahead=8, block=16, grouped=spark.createDataFrame(grouped, "id long, group_id long"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == want and len(want) > 10


def test_rerun_order():
    assert cull.rerun("exact") == ["exact", "near", "scene"] and cull.rerun("junk") == ["junk"] and cull.rerun("burst") == ["burst", "scene"]


# trees


def test_folder_tree(spark):
    df = spark.createDataFrame([(1, "Y/2001/J", 10), (2, "Y/2002/K", 5), (3, "Y/2002", 2), (4, "", 9)], "id long, path string, n long")
    got = {r.path: (r.id, r.depth, r.total, r.has_children) for r in trees.folder_tree(df).collect()}
    assert got == {"Y": (None, 0, 17, True), "Y/2001": (None, 1, 10, True), "Y/2001/J": (1, 2, 10, False), "Y/2002": (3, 1, 7, True), "Y/2002/K": (2, 2, 5, False)}


def test_identical_trees_are_reported_at_the_top(spark):
    data = [(s, f"{s}/{leaf}", h) for s in ("P", "Q") for leaf, h in (("x", "1"), ("y", "2"), ("z", "3"))] + [("R", "R/x", "1"), ("R", "R/q", None)]
    df = spark.createDataFrame(data, "scope string, path string, hash string")
    got = trees.identical_trees(df)
    assert {(r.scope, r.path, r.n) for r in got.collect()} == {("P", "P", 3), ("Q", "Q", 3), ("R", "R/x", 1)}


def test_compare_and_pair(spark):
    df = spark.createDataFrame([(1, 1, "a", "h"), (2, 1, "a", "h"), (3, 1, "b", "h"), (4, 1, "b", "h"), (5, 1, "b", "h"), (6, 1, "a", None), (7, 2, "a", "k"), (8, 2, "b", "k"), (9, 3, "a", "k")], "id long, p int, side string, hash string")
    assert {r.p: (r.common, r.verdict) for r in trees.compare_trees(df, ["p"]).collect()} == {1: (2, "partial"), 2: (1, "same"), 3: (0, "one_sided")}
    assert rows(trees.pair_files(df, ["p"], "id")) == [(1, 1, 5), (1, 2, 4), (2, 7, 8)]


def test_compare_goes_down_into_partial_folders(spark):
    data = [("a", "", "r"), ("b", "", "q"), ("a", "x", "1"), ("a", "x/y", "2"), ("b", "x", "1"), ("a", "s", "3"), ("b", "s", "3"), ("a", "s/t", "4"), ("b", "s/t", "4")]
    data += [("a", "p", "5"), ("a", "p", "6"), ("b", "p", "5"), ("b", "p", "7"), ("a", "p/in", "8"), ("b", "p/in", "8"), ("b", "p/in", "9"), ("a", "p/l", "1"), ("b", "z/r", "1"), ("a", "u", None), ("b", "u", None)]
    df = spark.createDataFrame([(1, *r, 10) for r in data] + [(2, "a", "", "1", 10), (2, "a", "k", "2", 10), (2, "b", "", "2", 10)], "p int, side string, sub string, hash string, size long")
    assert rows(trees.compare_folders(df, ["p"])) == sorted([
        (1, "", "partial", 1, 1, 0, 0), (1, "x", "b_in_a", 2, 1, 1, 10), (1, "s", "same", 2, 2, 2, 20), (1, "p", "partial", 2, 2, 1, 10), (1, "p/in", "a_in_b", 1, 2, 1, 10),
        (1, "p/l", "only_a", 1, 0, 0, 0), (1, "z/r", "only_b", 0, 1, 0, 0), (1, "u", "partial", 1, 1, 0, 0), (2, "", "b_in_a", 2, 1, 1, 10),
    ])


def test_labels_of_a_path_and_of_random_edges(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.root for r in cull.labels(path).collect()} == {0} and cull.labels(path.limit(0)).count() == 0
    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (50, 20), (300, 290), (300, 2000)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        ids, root = union_find(a, b)
        up = {int(x): int(x) for x in ids}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                up[x] = up[y] = min(up[x], up[y])
        assert dict(zip(ids.tolist(), root.tolist(), strict=True)) == up


def test_candidates_of_all_desk_libraries(spark, tmp_path):
    from silverfold.plans.records import candidates

    n = 10_001
    spark.range(n).selectExpr("id", "0 as area").write.parquet(f"{tmp_path}/libraries.parquet")
    spark.range(n).selectExpr("id", "id as library_id").write.parquet(f"{tmp_path}/folders.parquet")
    spark.range(5 * n).selectExpr("id", "cast(null as long) as trashed_at", "id % 10001 as folder_id", "1500000000 + id div 10001 as taken_at").write.parquet(f"{tmp_path}/files.parquet")
    assert candidates(spark, str(tmp_path)).count() == n


def test_identical_sets_keep_links_and_drop_lone_chains(spark):
    # P1 and P2 are equal and hold S, whose third copy T lies elsewhere; V/w/x is a chain without a partner; A and B hold C and nothing else does
    data = [("P1", "P1/S", "1"), ("P1", "P1/o", "2"), ("P2", "P2/S", "1"), ("P2", "P2/o", "2"), ("T", "T", "1"), ("V", "V/w/x", "3"), ("A", "A/C", "4"), ("A", "A/d", "5"), ("B", "B/C", "4"), ("B", "B/d", "5"), ("N", "N", None), ("M", "M", None)]
    got = trees.identical_sets(spark.createDataFrame(data, "scope string, path string, hash string"))
    sets = {}
    for r in got.collect():
        sets.setdefault(r.signature, set()).add(r.path)
    assert sorted(map(sorted, sets.values())) == [["A", "B"], ["P1", "P2"], ["P1/S", "P2/S", "T"]]


def test_merges_and_journals_of_many_at_once(spark):
    f = spark.createDataFrame([(1, 1, "a", "X.jpg", "h"), (2, 1, "a", "y.jpg", "k"), (3, 2, "a", "y.jpg", "h"), (4, 2, "a", "z.jpg", None), (5, 1, "b", "Y.jpg", "h"), (6, 2, "b", "Z.jpg", None)], "id long, p int, side string, name string, hash string")
    a, b = f.where("side = 'a'"), f.where("side = 'b'")
    assert rows(ledger.merge_plan(a, b, ["p"])) == [(1, 1, "drop"), (1, 2, "rename"), (2, 3, "move"), (2, 4, "rename")]
    m = f.select("id", "p", F.col("name").alias("from_path"), F.col("name").alias("to_path"), F.lit(1).alias("size"), F.lit(2).alias("modified_at"))
    assert rows(ledger.journal_rows(m, "p", 9).select("batch_id", "seq", "id")) == [(1, 1, 1), (1, 2, 2), (1, 3, 5), (2, 1, 3), (2, 2, 4), (2, 3, 6)]
    assert rows(ledger.journal_rows(m, 7, 9).select("batch_id", "seq")) == [(7, i) for i in range(1, 7)]


def test_dated_folders_get_their_normal_name(spark):
    f = [("2024_08_27 trip", 1), ("2024_08_27 trip/20240828_second", 2), ("2024.09.01 fair", 4), ("2024-09-01 fair", 8), ("2024_02_30 never", 16), ("20240827", 32), ("2024-08-27  wide", 64), ("plain", 128)]
    f += [("up/2024.10.01-x/raw", 3), (".hid/20240101", 5), ("2024-08-27_late", 0)]
    df = spark.createDataFrame([(1, p, p.split("/")[-1], n) for p, n in f] + [(2, "2024.09.01 fair", "2024.09.01 fair", 1)], "l long, path string, name string, n long")
    assert rows(trees.name_audit(df, ["l"]).select("l", "source_dir", "proposed_name", "reason", "file_count", "conflict")) == sorted([
        (1, "2024_08_27 trip", "2024-08-27 trip", "underscores", 3, False), (1, "2024_08_27 trip/20240828_second", "2024-08-28 second", "joined", 2, False),
        (1, "2024.09.01 fair", "2024-09-01 fair", "dots", 4, True), (1, "20240827", "2024-08-27", "joined", 32, False), (1, "2024-08-27  wide", "2024-08-27 wide", "joined", 64, False),
        (1, "up/2024.10.01-x", "2024-10-01 x", "dots", 3, False), (1, "2024-08-27_late", "2024-08-27 late", "joined", 0, False), (2, "2024.09.01 fair", "2024-09-01 fair", "dots", 1, False),
    ])


def test_husks(spark):
    f = spark.createDataFrame([("v", p) for p in ("a", "a/b", "a/b/c", "d", "d/e")], "v string, path string")
    n = spark.createDataFrame([("v", "d/e", 3), ("v", "a/b", 0)], "v string, path string, n long")
    assert rows(trees.husks(f, n, ["v"])) == [("v", "a", 3)]


# places


def test_cells(spark):
    df = spark.createDataFrame([(37.2846, 127.0512), (37.2899, 127.0599), (-33.8688, 151.2093), (-0.001, 0.0)], "gps_lat double, gps_lon double")
    assert [r.c for r in df.select(places.cell_key(F.col("gps_lat"), F.col("gps_lon")).alias("c")).collect()] == ["37.28,127.05", "37.28,127.05", "-33.87,151.20", "-0.01,0.00"]
    more = df.union(df.limit(1)).union(spark.createDataFrame([(None, 1.0), (0.0, 0.0)], "a double, b double"))
    assert {r.cell: (r.lat, r.n) for r in places.medoids(more).collect()}["37.28,127.05"] == (37.2846, 3)


def test_names_of_points(spark):
    sq = lambda x0, y0, x1, y1: [[[[x0, y0], [x1, y0], [x1, y1], [x0, y1]]]]
    reg = spark.createDataFrame([(1, "K", "Land", 1, None, [0.0, 0.0, 10.0, 10.0], sq(0.0, 0.0, 10.0, 10.0)), (2, "K-1", "West", 2, "K", [0.0, 0.0, 5.0, 10.0], sq(0.0, 0.0, 5.0, 10.0)), (3, "K-2", "East", 2, "K", [5.0, 0.0, 10.0, 10.0], sq(5.0, 0.0, 10.0, 10.0)), (4, "F", "Far", 1, None, [20.0, 0.0, 30.0, 10.0], sq(20.0, 0.0, 30.0, 10.0))], "id long, code string, name string, level int, parent_code string, bbox array<double>, polys array<array<array<array<double>>>>")
    city = spark.createDataFrame([(1, 5.0, 4.99, "K", "Border", "East", 5), (2, 2.0, 2.0, "K", "West", "West", 5), (3, 8.0, 8.1, "K", "Oak", "East", 5), (4, 5.0, 25.0, "F", "Ford", "Shire", 1)], "id long, lat double, lon double, code string, name string, admin1 string, pop long")
    pts = spark.createDataFrame([(1, 5.0, 4.98), (2, 2.0, 2.01), (3, 8.0, 8.0), (4, 5.0, 25.01), (5, 1.0, 29.0), (6, 50.0, 50.0)], "id long, lat double, lon double")
    got = {r.id: (r.country, r.admin1, r.admin2, r.precision) for r in places.resolve(pts, reg, city).collect()}
    assert got == {1: ("Land", "East", "Border", "approximate"), 2: ("Land", "West", None, "approximate"), 3: ("Land", "East", "Oak", "approximate"), 4: ("Far", "Shire", "Ford", "approximate"), 5: ("Far", None, None, "boundary")}


def test_answers(spark):
    df = spark.createDataFrame([("KR", "kr", True, 3, 3), ("KR", "JP", None, 3, 0), ("KR", None, None, 3, 0), (None, "JP", None, 1, 0), ("KR", "KR", False, 3, 0), (None, None, None, 1, 2)], "b string, a string, o boolean, n int, d int")
    assert [r.v for r in df.select(places.judge(*(F.col(c) for c in "baond")).alias("v")).collect()] == ["accept", "conflict", "shallow", "accept", "conflict", "shallow"]
    names = F.array(F.lit("Gangwon-do"), F.lit("서울특별시"))
    m = spark.createDataFrame([("gangwon", "Gangwon-do"), ("서울", "Gangwon-do"), ("Paris", "Gangwon-do"), ("x", None)], "n string, h string")
    assert [r.m for r in m.select(places.region_matches(F.col("n"), F.col("h"), names).alias("m")).collect()] == [True, False, None, None]
    a = spark.createDataFrame([('{"country":"Land","state":"S","city":"C","town":"C","country_code":"ld"}',), ('{"city":"C","suburb":"B"}',), ("{oops",), (None,)], "a string")
    got = [tuple(r.x) for r in a.select(places.fold_address(F.col("a")).alias("x")).collect()]
    assert got[0] == ("Land", "S", "C", "LD") and got[1][1:3] == ("C", "B") and got[2][0] is None and got[3][0] is None
    one = lambda text: tuple(spark.range(1).select(places.fold_address(F.lit(text)).alias("x")).first().x)[:3]
    assert one('{"country":"X","city":"Suwon"}') == ("X", "Suwon", None)
    assert one('{"state":"S","province":"P","city":"C"}') == (None, "S", "C")
    assert one('{"state_district":"D","village":"V","suburb":"U"}') == (None, "D", "V")
    assert one('{"state":"S","city":"S","borough":"B"}') == (None, "S", "B") and one("{}") == (None, None, None)
    b = spark.range(1).select(places.safe_bbox(F.lit(-95.0), F.lit(170.0), F.lit(10.0), F.lit(-170.0)).alias("b")).first().b
    assert tuple(b) == (-90.0, -180.0, 10.0, 180.0)


# vectors


def test_similar_and_people(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, [0.0, 1.0]), (5, [1.0])], "id long, embedding array<double>")
    assert [r.id for r in vectors.similar(df, 1, 2).collect()] == [2, 3]
    assert vectors.similar(df, 99, 2).count() == 0
    faces = spark.createDataFrame([(0, 1, None, [1.0, 0.0, 0.0]), (0, 2, None, [0.9, 0.1, 0.0]), (0, 3, None, [0.0, 1.0, 0.0]), (0, 4, None, [0.95, 0.05, 0.0])], "part int, id long, person_id long, embedding array<double>")
    got = dict(tuple(r) for r in vectors.people(faces).collect())
    assert got[1] == got[2] == got[4] != got[3]
    assert np.allclose(vectors.mean_pool(np.array([[1.0, 0], [3.0, 0], [9.0, 9]]), np.array([1, 1, 0]), np.eye(2)), [1, 0])
    z = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vectors.normalize(F.col("v")).alias("n")).collect()
    assert [r.n for r in z] == [[0.6, 0.8], [0.0, 0.0]]


def test_suppression():
    b = pd.DataFrame({"x": [0, 1, 50, 0], "y": [0, 1, 50, 0], "w": [10, 10, 10, 10], "h": [10, 10, 10, 10], "cls": [0.9, 0.95, 0.9, 0.2], "obj": [0.9, 0.95, 0.9, 0.2]})
    assert vectors.suppress(b)[["x"]].values.ravel().tolist() == [1, 50]


# plans


def test_merge_keeps_and_drops(spark):
    s = "path string, size long, modified_at long, gps_lat double, gps_lon double"
    known = spark.createDataFrame([("a", 1, 1, 1.0, 1.0, "h", "p"), ("b", 1, 1, 1.0, 1.0, "h", "p"), ("c", 1, None, None, None, "h", "p"), ("d", 1, 1, 1.0, 1.0, "h", "p")], s + ", hash string, place string")
    scan = spark.createDataFrame([("a", 1, 1, 1.0, 1.0), ("b", 2, 1, 2.0, 1.0), ("c", 1, None, None, None), ("e", 5, 5, None, None)], s)
    got = {r.path: (r.size, r.hash, r.place) for r in ledger.merge_scan(known, scan, "path", ["hash"], ["place"]).collect()}
    assert got == {"a": (1, "h", "p"), "b": (2, None, None), "c": (1, "h", "p"), "d": (1, "h", "p"), "e": (5, None, None)}


def test_missing_is_guarded(spark):
    known = spark.range(200)
    allowed = lambda seen: {r.allowed for r in ledger.missing(known, seen, "id").collect()}
    assert allowed(spark.range(150)) == {True} and allowed(spark.range(90)) == {False} and allowed(spark.range(0)) == {False} and allowed(spark.range(200)) == set()


def test_transfer_and_names(spark):
    picks = spark.createDataFrame([(1, 9, "A.jpg", "h1", 1, 2), (2, 9, "a.jpg", "h2", 1, 2), (3, 9, "b.jpg", "h3", 0, 2), (4, 9, "c.jpg", "h4", 0, 2), (5, 9, "d.jpg", None, 1, 2)], "id long, folder_id long, name string, hash string, from_area int, to_area int")
    there = spark.createDataFrame([(9, "B.JPG")], "folder_id long, name string")
    done = spark.createDataFrame([("h4",)], "hash string")
    got = {r.id: r.action for r in ledger.transfer_plan(picks, there, done, rename=False).collect()}
    assert got == {1: "copy", 2: "skip_name", 3: "skip_name", 4: "skip_published", 5: "copy"}
    free = ledger.free_names(picks, there, "folder_id", "name", "id")
    assert {r.id: r.free_name for r in free.collect()} == {1: "A.jpg", 2: "a (2).jpg", 3: "b (2).jpg", 4: "c.jpg", 5: "d.jpg"}


def test_free_names_pass_taken_numbers(spark):
    want = lambda *names: spark.createDataFrame([(i, 1, n) for i, n in enumerate(names)], "id long, f long, name string")
    free = lambda w, t: [r.free_name for r in ledger.free_names(w, t, "f", "name", "id").orderBy("id").collect()]
    assert free(want("a.jpg", "a.jpg"), want("a.jpg", "a (1).jpg")) == ["a (2).jpg", "a (3).jpg"]
    assert free(want("a.jpg", "a.jpg", "a.jpg"), want("A.JPG", "a (2).jpg", "a (4).jpg")) == ["a (3).jpg", "a (5).jpg", "a (6).jpg"]
    assert free(want("a.jpg", "a (2).jpg", "a.jpg", "noext", "noext"), want("x")) == ["a.jpg", "a (2).jpg", "a (3).jpg", "noext", "noext (2)"]
    assert free(want("a (02).jpg", "a.jpg", ".hid", ".hid"), want("a.jpg", "a (9999999999).jpg")) == ["a (02).jpg", "a (2).jpg", ".hid", ".hid (2)"]
    assert free(want(), want("a")) == [] and free(want("a"), want()) == ["a"]


def test_verify_refuses_below_nine_tenths(spark):
    known = spark.createDataFrame([(lib, 100 * lib + i) for lib in (1, 2, 3) for i in range(10)] + [(None, 5), (1, 100)], "lib long, id long")
    present = known.where("(lib = 1 and id <> 100) or (lib = 2 and id >= 203)")
    got = rows(ledger.verify(known, present, "id", "lib"))
    assert [r for r in got if r[0] < 3] == [(1, 100, True), (2, 200, False), (2, 201, False), (2, 202, False)] and {r[2] for r in got if r[0] == 3} == {False}


def test_sync(spark):
    s = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 90), ("d", 1, 10), ("x/t.tmp", 1, 1), ("n", 1, 1)], "path string, size long, modified_at long")
    t = spark.createDataFrame([("a", 1, 11), ("b", 1, 10), ("c", 1, 10), ("d", 1, 90), ("o", 1, 1)], "path string, size long, modified_at long")
    assert rows(ledger.sync_plan(s, t, ["path"], ["*.tmp"])) == [("b", "size_changed"), ("c", "modified"), ("d", "conflict"), ("n", "new"), ("o", "orphan")]


def test_import(spark):
    found = spark.createDataFrame([("p", "a", 1, "h", 0), ("p", "a", 1, "h", 0), ("q", "a", 1, "k", 86400), ("r", "b", 1, None, 0)], "path string, name string, size long, hash string, taken_at long")
    known = spark.createDataFrame([("a", 1, "h"), ("b", 1, "z")], "name string, size long, hash string")
    look = ledger.import_look(found, known)
    assert rows(look) == [("p", "1970-01-01", 1, True), ("q", "1970-01-02", 1, False), ("r", "1970-01-01", 1, True)]
    p = ledger.import_preview(look).first()
    assert (p.n, p.bytes, p.dups, p.days) == (3, 3, 2, ["1970-01-01", "1970-01-02"])


# sources


def test_walk(spark, tmp_path):
    for p in ("a/x.JPG", "a/.hidden.jpg", "a/@eaDir/t.jpg", "b c+d/y.mov", "b c+d/n.txt", "é.cr2"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"12345")
    got = {r.rel_path: (r.kind, r.size) for r in media.walk(spark, str(tmp_path)).collect()}
    assert got == {"a/x.JPG": (0, 5), "b c+d/y.mov": (1, 5), "é.cr2": (2, 5)}


def test_snapshots_of_reference_tables(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# head\n1.5\t2.5\tTown\tKR\t11\tX\tY\t500\t읍\n95\t1\tBad\tKR\t\t\t\t1\t\nbroken\n")
    assert [(r.name, r.population) for r in media.cities(spark, str(tmp_path / "c.tsv")).collect()] == [("Town", 500)]
    (tmp_path / "r.json").write_text('[{"code":"A","name":"n","level":1,"bbox":[0,0,1,1],"polys":[[[[0,0],[1,0],[1,1]]]]}]')
    assert media.regions(spark, str(tmp_path / "r.json")).first().polys[0][0][1] == [1.0, 0.0]
    n = spark.createDataFrame([("k", "long name", False), ("k", "short", False), ("j", "zz", True), ("j", "a", None)], "k string, name string, preferred boolean")
    assert rows(media.preferred_names(n, "k")) == [("j", "zz"), ("k", "short")]


def test_sidecars_and_stats(spark):
    f = spark.createDataFrame([(1, "a.jpg", 3, 0, False), (2, "b.jpg", 0, 0, False), (3, "c.jpg", 5, 2, True), (4, "d.jpg", 0, 0, False)], "id long, name string, rating int, culling_flag int, favorite boolean")
    t = spark.createDataFrame([(4, "x & y"), (4, "x & y")], "file_id long, tag string")
    got = {r.id: r.xmp for r in media.sidecars(f, t).collect()}
    assert set(got) == {1, 3, 4} and 'Rating="3"' in got[1] and 'Rating="-1"' in got[3] and "<rdf:li>x &amp; y</rdf:li>" in got[4]
    s = spark.createDataFrame([("Number of files: 1,234\nNumber of regular files transferred: 5\nTotal transferred file size: 9,876 bytes",), ("",)], "t string").select(media.transfer_stats(F.col("t")).alias("s")).collect()
    assert tuple(s[0].s) == (1234, 5, 9876) and tuple(s[1].s) == (None, None, None)
    assert media.old_snapshots(["2", "1", "3"], 2) == ["1"]


# streams


def test_debounce_on_a_table_and_a_stream(spark, tmp_path):
    t = [("a", 0.0), ("a", 1.5), ("a", 3.1), ("b", 0.2)]
    df = spark.createDataFrame(t, "k string, s double").select("k", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))
    want = [("a", 1), ("a", 2), ("b", 1)]
    assert rows(watch.debounce(df, ["k"]).select("k", "n")) == want
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    at = str(tmp_path / "w")
    assert rows(watch.run_to_end(watch.debounce(watch.with_end(src, "ts", at), ["k"]), at).where("k is not null").select("k", "n")) == want


def test_rate(spark):
    df = spark.createDataFrame([(0, 0), (1, 10), (10, 100), (50, 200)], "s long, done long").select(F.timestamp_seconds("s").alias("ts"), "done", F.lit(1).alias("k"))
    assert [r.rate for r in watch.sliding_rate(df, ["k"], "ts", "done").orderBy("ts").collect()] == [None, None, 10.0, None]
    p = spark.createDataFrame([("a/b.jpg",), ("a/.x/b.jpg",), ("@eaDir/x",)], "p string").select(watch.interesting(F.col("p"), ["@eaDir"]).alias("i")).collect()
    assert [r.i for r in p] == [True, False, False]


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_of_set_is_exact_with_ties(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "TILE_ROWS", 40)
    rng = np.random.default_rng(2)
    m = rng.integers(-2, 3, (130, 4)).astype(float)  # many equal scores
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(500)[:130], m, strict=True)], "id long, embedding array<double>")
    data = {r.id: np.array(r.embedding) for r in df.collect()}
    q = df.where("id % 5 = 0")
    got = sorted((r.q_id, r.id, r.score) for r in vectors.nearest_of_set(df, q, 6, block=block).collect())
    want = []
    for a in data:
        if a % 5 == 0:
            want += [(a, b, float(data[a] @ data[b])) for b in sorted((x for x in data if x != a), key=lambda x: (-float(data[a] @ data[x]), x))[:6]]
    assert got == sorted(want)
    assert vectors.nearest_of_set(df, q.limit(0), 3).count() == 0


def test_faces_of_pictures(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 0.9, 0.9), (1, 1.0, 1.0, 10.0, 10.0, 0.95, 0.95), (1, 50.0, 0.0, 10.0, 10.0, 0.9, 0.9), (2, 0.0, 0.0, 5.0, 5.0, 0.5, 0.5), (3, 0.0, 0.0, 5.0, 5.0, None, 0.9)], "pic long, x double, y double, w double, h double, cls double, obj double")
    assert [(r.pic, r.x) for r in vectors.faces_of(d, "pic").orderBy("x").collect()] == [(1, 1.0), (1, 50.0)]


def test_sentence_vectors(spark):
    df = spark.createDataFrame([(1, [[1.0, 0.0], [3.0, 0.0], [9.0, 9.0]], [1, 1, 0], [[2.0, 0.0], [0.0, 1.0]]), (2, None, [1], [[1.0]])], "id long, t array<array<double>>, m array<int>, d array<array<double>>")
    got = {r.id: r.v for r in df.select("id", vectors.sentence_vector("t", "m", "d").alias("v")).collect()}
    assert got == {1: [1.0, 0.0], 2: None}


def test_pictures_in_columns(spark):
    rgb = bytes([0, 1, 2] * 32 + [255, 254, 253] * 32)
    df = spark.createDataFrame([(1, rgb), (2, b"xx"), (3, None)], "id long, rgb binary")
    got = {r.id: r.h for r in df.select("id", content.histogram_of("rgb").alias("h")).collect()}
    assert (got[1].peak, got[1].shadows, got[1].lights) == (32, 0.5, 0.5) and got[2].peak is None and got[3].peak is None
    flat = spark.createDataFrame([(bytes([7] * 1024), bytes([9] * 192)), (b"", None)], "g binary, c binary")
    a, b = (r.s for r in flat.select(content.signature_of("g", "c").alias("s")).collect())
    assert len(a) == 385 and a[0] == 1 and set(a[1:257]) == {7} and b is None
    assert content.cache_keys([], np.array([], np.int64), np.array([], np.int64)).tolist() == []


def test_snapshots_are_kept_and_restored(spark, tmp_path):
    at = str(tmp_path / "snaps")
    with pytest.raises(ValueError):
        media.restore(spark, at)
    for v in ("100", "90", "300"):
        media.snapshot(spark.range(int(v) // 10), at, v)
    assert media.versions(spark, at) == ["100", "300", "90"]
    assert media.restore(spark, at, "300").count() == 30
    assert media.snapshot_due([], 5) and media.snapshot_due(["100"], 100 + 86400) and not media.snapshot_due(["100", "90"], 86399)
    assert media.prune_snapshots(spark, at, 2) == ["100"] and len(media.versions(spark, at)) == 2


def test_broken_media_give_nothing(spark):
    assert media.container_seconds(None) is None and media.container_seconds(b"") is None and media.container_seconds(bytes(40)) is None
    assert media.container_seconds(bytes.fromhex("000000206D6F6F76" "000000186D766864" "00000000" "00000000")) is None
    none = dict.fromkeys(("make", "model", "taken", "iso", "lens", "lat", "lon", "alt"))
    for data in (None, b"", b"\xff\xd8\xff", b"\xff\xd8\xff\xe1\x00\x10Exif\0\0II*\0\xff\xff\xff\x7f", b"plain"):
        assert media.exif_fields(data) == none
    line = spark.range(1).select(media.transfer_progress(F.lit(" 1,234  56%   7.89MB/s    0:00:10")).alias("a"), media.transfer_progress(F.lit("x")).alias("b")).first()
    assert tuple(line.a) == (1234, 56, "7.89MB/s") and line.b is None


def test_cursor_by_counts_equals_sorting(spark):
    from silverfold.operators import catalog as c

    rng = random.Random(1)
    data = [(i, None, rng.choice([None, 5, 5, 5, rng.randrange(10**9)]), rng.choice(["", "a", "ab", "Abc", "ab" * rng.randrange(4), None]), 1) for i in range(120)]
    k = c.Catalog(spark.createDataFrame(data, "id long, trashed_at long, taken_at long, name string, folder_id long"), spark.createDataFrame([], "id long"))
    for sort, descending in (("taken", True), ("taken", False), ("name", True), ("name", False)):
        f = c.Filter(sort=sort, descending=descending)
        key = (lambda r: (r[2] or 0, r[0])) if sort == "taken" else (lambda r: (r[3] or "", r[0]))
        line = sorted(data, key=key, reverse=descending)
        for at in (1, 37, 80, 120, 121):
            got = c.cursor_at(k, f, at, most=3).collect()
            assert [r.id for r in got] == [r[0] for r in line[at - 1 : at]], (sort, descending, at)


def test_suggested_names_near_and_far(spark):
    from silverfold.operators import naming

    rng = random.Random(3)
    places = [(37.5, 127.0), (0.0, 180.0), (89.99, 10.0), (-89.99, -170.0), (60.0, -180.0), (37.51, 127.02)]
    at = lambda: (lambda p: (max(-90.0, min(90.0, p[0] + rng.uniform(-0.04, 0.04))), (p[1] + rng.uniform(-0.06, 0.06) + 180) % 360 - 180))(rng.choice(places))
    folders = [(i, None, f"t{i}", *at()) for i in range(150)] + [(900, None, "", 37.5, 127.0), (901, None, "no place", None, None)]
    sels = [(i, None, *at()) for i in range(40)] + [(99, None, None, None)]
    f = spark.createDataFrame(folders, "folder_id long, date string, title string, lat double, lon double")
    got = naming.suggest(spark.createDataFrame(sels, "sel long, day string, lat double, lon double"), f, limit=1000)

    def km(a, o, b, p):
        x = np.sin(np.radians(b - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(b)) * np.sin(np.radians(p - o) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(x)))

    want = sorted((s[0], k[2], 90 - int(km(s[2], s[3], k[3], k[4]) * 10)) for s in sels if s[2] is not None for k in folders if k[2] and k[3] is not None and km(s[2], s[3], k[3], k[4]) < 3)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
    dated = spark.createDataFrame([(1, "2020-05-04", "Lake 2일차", None, None), (2, "2019-05-05", "Birthday", None, None), (3, "2020-05-05", "Today", None, None)], f.schema)
    one = spark.createDataFrame([(7, "2020-05-05", None, None)], "sel long, day string, lat double, lon double")
    assert [tuple(r) for r in naming.suggest(one, dated, 5).orderBy(F.desc("score")).collect()] == [(7, "Lake 3일차", 120), (7, "Birthday", 100)]
    assert naming.suggest(one, dated.limit(0)).count() == 0


def test_event_limits(spark):
    from silverfold.operators import naming

    df = spark.createDataFrame([(1, i, 86400 * 400 + t) for i, t in enumerate((0, 100, 1900, 3701, 9000))] + [(1, 9, 86400 * 401), (1, 10, 86400 * 401 + 5)], "library_id long, id long, taken_at long")
    e = naming.event_candidates(df, 1, 0)
    assert [(r.n, r.end_at - r.start_at) for r in e.orderBy("start_at").collect()] == [(3, 1900), (2, 5)]
    assert [tuple(r)[1:] for r in naming.event_items(df, e).orderBy("cand_key", "seq").collect()] == [(0, 1), (1, 2), (2, 3), (9, 1), (10, 2)]
