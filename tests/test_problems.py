"""The general problems' operators on small tables, against brute force."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from silverfold.operators.diff import diff_copies, nfc
from silverfold.operators.hierarchy import hierarchy
from silverfold.operators.nearby import nearby
from silverfold.operators.sessions import sessionize
from silverfold.operators.skew import prefix_sums, skew_join


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# sessions


def brute_sessions(events, gap, day_split):
    out = []
    for k in {e[0] for e in events}:
        run = []
        for t in sorted(t for kk, t in events if kk == k and t is not None):
            if run and (t - run[-1] > gap or (day_split and t // 86400 != run[-1] // 86400)):
                out.append((k, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
        if run:
            out.append((k, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(x for x in out if x[0] is not None)


@pytest.mark.parametrize("day_split", [True, False])
def test_sessions_match_brute_force(spark, day_split):
    rng = random.Random(1)
    events = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(80000, 95000, 311), *range(170000, 260000, 997)])) for _ in range(600)]
    df = spark.createDataFrame(events, "k long, t long").withColumn("start_at", F.lit("clash"))
    for gap in (0, 311, 1800, 90000):
        assert rows(sessionize(df, "k", "t", gap, day_split=day_split)) == brute_sessions(events, gap, day_split)


def test_session_gap_is_inclusive(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 21)], "k string, t long")
    assert rows(sessionize(df, "k", "t", 10)) == [("a", 0, 10, 10, 2), ("a", 21, 21, 0, 1)]


def test_sessions_of_an_empty_table(spark):
    assert rows(sessionize(spark.createDataFrame([], "k long, t long"), "k", "t", 10)) == []


# hierarchies


def brute_tree(nodes, names):
    parent = {i: p if p in nodes else None for i, p in nodes.items()}
    out, kids = {}, {}
    for i in parent:
        path, x = [], i
        while x is not None and x not in path:
            path.append(x)
            x = parent[x]
        if x is None:
            out[i] = ("tree", path[-1], len(path) - 1, "/".join(names[v] for v in reversed(path)))
            for v in path[1:]:
                kids[v] = kids.get(v, 0) + 1
        else:
            ring = path[path.index(x):]
            at = path.index(x)
            out[i] = ("cycle" if at == 0 else "tail", min(ring), at, "")
    return sorted((i, *v, kids.get(i, 0) if v[0] == "tree" else -1) for i, v in out.items())


def test_hierarchy_matches_brute_force(spark):
    rng = random.Random(2)
    nodes = {i: rng.choice([None, 999, *range(max(0, i - 4), i)]) if i else None for i in range(120)}
    nodes |= {200 + i: 200 + (i + 1) % 7 for i in range(7)} | {300: 300, 301: 300, 302: 301, 310: 203, 311: 310, 320: 321, 321: 320}
    nodes |= {1000 + i: (999 + i if i else None) for i in range(70)} | {2000 + i: 1000 for i in range(50)}
    names = {i: f"n{i}" for i in nodes}
    data = [(i, p, names[i], 7) for i, p in nodes.items()]
    df = spark.createDataFrame(data + data[:20] + [(None, 1, "x", 0)], "id long, parent_id long, name string, depth int")
    assert rows(hierarchy(df)) == brute_tree(nodes, names)


def test_hierarchy_intervals_hold_the_descendants(spark):
    nodes = {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: 5, 7: 3, 8: None, 9: 8, 10: 10}
    df = spark.createDataFrame([(i, p, "x") for i, p in nodes.items()], "id long, parent_id long, name string")
    got = {r.id: r for r in hierarchy(df, intervals=True).collect()}
    for v in nodes:
        if got[v].link_kind == "cycle":
            assert got[v].pre is None
            continue
        inside = {u for u in nodes if got[u].root_id == got[v].root_id and got[u].pre is not None and got[v].pre < got[u].pre <= got[v].last}
        below, todo = set(), [v]
        while todo:
            x = todo.pop()
            new = {u for u, p in nodes.items() if p == x and u != x}
            below |= new
            todo += new
        assert inside == below and got[v].n_desc == len(below)


def test_hierarchy_of_an_empty_table_and_null_names(spark):
    assert rows(hierarchy(spark.createDataFrame([], "id long, parent_id long, name string"))) == []
    df = spark.createDataFrame([(1, None, None), (2, 1, "b")], "id long, parent_id long, name string")
    assert [r.full_path for r in hierarchy(df).orderBy("id").collect()] == ["", "/b"]


# differences


def test_diff_matches_brute_force(spark):
    rng = random.Random(3)
    side = lambda: {(rng.randrange(3), f"k{rng.randrange(300)}"): (rng.randrange(3), rng.choice(["u", "v", None])) for _ in range(400)}
    a = side()
    b = {k: v if rng.random() < 0.9 else (9, None) for k, v in a.items() if rng.random() < 0.95} | {(7, "only"): (1, "x")}
    make = lambda d: spark.createDataFrame([(*k, *v, 0) for k, v in d.items()] * 2, "p int, path string, size int, h string, field int")
    want = []
    for k in a.keys() | b.keys():
        if k not in b or k not in a:
            want.append((*k, "only_a" if k in a else "only_b"))
        else:
            want += [(*k, f) for f, x, y in zip(("size", "h"), a[k], b[k], strict=True) if x != y]
    for chunk in (1, 4, 1000):
        assert rows(diff_copies(make(a), make(b), ["p", "path"], ["size", "h"], chunk)) == sorted(want)


def test_diff_with_null_keys_and_empty_sides(spark):
    a = spark.createDataFrame([(None, 1), ("x", None)], "k string, v int")
    none = spark.createDataFrame([], "k string, v int")
    assert diff_copies(a, a, ["k"], ["v"]).count() == 0
    assert {(r.k, r.field) for r in diff_copies(a, none, ["k"], ["v"]).collect()} == {(None, "only_a"), ("x", "only_a")}
    assert {(r.k, r.field) for r in diff_copies(none, a, ["k"], ["v"]).collect()} == {(None, "only_b"), ("x", "only_b")}
    assert diff_copies(none, none, ["k"], ["v"]).count() == 0


def test_nfc(spark):
    texts = ["plain", "é", None, "", "한" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", nfc(F.col("t")))
    assert [r.n for r in df.collect()] == [t and unicodedata.normalize("NFC", t) if t else t for t in texts]


# places


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


SQUARE = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[4.0, 4.0], [6.0, 4.0], [6.0, 6.0], [4.0, 6.0]]]
ISLE = [[[4.5, 4.5], [5.5, 4.5], [5.5, 5.5], [4.5, 5.5]]]


@pytest.mark.parametrize("leaf_points", [5, 20000])
def test_nearby_matches_brute_force(spark, leaf_points):
    rng = random.Random(4)
    spots = [(5.0, 5.0), (3.0, 3.0), (0.0, 179.9999), (89.9999, 10.0), (-89.9999, -100.0), (45.0, -180.0)]
    pts = {}
    for i in range(400):
        s = rng.choice(spots)
        d = rng.choice([0.0005, 0.002, 1.5])
        lat, lon = s[0] + rng.uniform(-d, d), s[1] + rng.uniform(-d, d) * (40 if abs(s[0]) > 80 else 1)
        pts[i] = (max(-90.0, min(90.0, lat)), (lon + 180) % 360 - 180)
    data = [(i, *p, "x") for i, p in pts.items()]
    bad = [(900, None, 1.0, "x"), (901, float("nan"), 1.0, "x"), (902, 91.0, 1.0, "x"), (None, 5.0, 5.0, "x")]
    points = spark.createDataFrame(data + data[:30] + bad, "id long, lat double, lon double, leaf string")
    regions = spark.createDataFrame([(1, "A", 1, [0.0, 0.0, 10.0, 10.0], [SQUARE]), (2, "B", 1, [4.5, 4.5, 5.5, 5.5], [ISLE]), (3, "A-1", 2, [2.0, 2.0, 3.0, 3.0], [[[[2.0, 2.0], [3.0, 2.0], [3.0, 3.0], [2.0, 3.0]]]])], "id long, code string, level int, bbox array<double>, polys array<array<array<array<double>>>>")
    cities = spark.createDataFrame([(1, 5.0, 5.01, "B", 10), (2, 5.0, 5.01, "B", 20), (3, 5.01, 5.0, "A", 5), (4, 2.5, 2.5, "A", 1), (5, 3.01, 3.0, "A", None)], "id long, lat double, lon double, code string, pop long")
    inside = {1: lambda y, x: 0 < x < 10 and 0 < y < 10 and not (4 < x < 6 and 4 < y < 6), 2: lambda y, x: 4.5 < x < 5.5 and 4.5 < y < 5.5, 3: lambda y, x: 2 < x < 3 and 2 < y < 3}
    want = [("near", i, j) for i in pts for j in pts if i < j and km(pts[i], pts[j]) <= 0.1]
    want += [("in", i, r) for i, p in pts.items() for r, f in inside.items() if f(*p)]
    town = {1: (5.0, 5.01, "B", 10), 2: (5.0, 5.01, "B", 20), 3: (5.01, 5.0, "A", 5), 4: (2.5, 2.5, "A", 1), 5: (3.01, 3.0, "A", 0)}
    for i, p in pts.items():
        codes = {c for c, r in (("A", 1), ("B", 2)) if inside[r](*p)}
        near = sorted((km(p, t), -t[3], c) for c, t in town.items() if t[2] in codes and km(p, t) <= 20)
        want += [("city", i, near[0][2])] if near else []
    got = nearby(points, regions, cities, leaf_points=leaf_points).select("rel", "a_id", "b_id")
    assert rows(got) == sorted(want)


def test_nearby_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, lat double, lon double")
    assert nearby(none).count() == 0
    one = spark.createDataFrame([(1, 5.0, 5.0)], "id long, lat double, lon double")
    assert nearby(one).count() == 0


# skew helpers


def test_skew_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 5 if i % 7 else None, i) for i in range(100)], "k int, i int")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "n")], "k int, v string")
    for how in ("left", "inner"):
        plain = rows(left.join(right, "k", how).fillna("-").fillna(-1))
        assert rows(skew_join(left, right, "k", how, hot=[0, 3]).fillna("-").fillna(-1)) == plain


def test_prefix_sums(spark):
    df = spark.createDataFrame([(g, i, i + 1) for g in (1, 2) for i in range(50)], "g int, i int, n int")
    got = prefix_sums(df, ["g"], ["i"], "n", "c", buckets=4).collect()
    for g in (1, 2):
        c = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.c):
            assert r.c == c
            c += r.n


def test_hot_spot_is_tiled_and_streamed(spark):
    import numpy as np
    import pandas as pd

    from silverfold.operators.nearby import HOME, _probe, haversine_km
    from silverfold.operators.rtree import MOST_PAIRS

    # a third of the points on one spot, a third within a few metres, the rest spread; antimeridian too
    rng = np.random.default_rng(3)
    lat = np.concatenate([np.full(700, 37.5), 37.5 + rng.uniform(0, 1e-4, 700), rng.uniform(-1e-4, 1e-4, 600)])
    lon = np.concatenate([np.full(700, 127.0), 127.0 + rng.uniform(0, 1e-4, 700), np.where(np.arange(600) % 2 == 0, 180.0, -180.0) - rng.uniform(0, 1e-4, 600) * np.where(np.arange(600) % 2 == 0, 1, -1)])
    points = pd.DataFrame({"id": rng.permutation(2000), "lat": lat, "lon": lon})
    got = nearby(spark.createDataFrame(points), leaf_points=100).where("rel = 'near'").select("a_id", "b_id").toPandas()
    d = haversine_km(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    ids = points["id"].to_numpy()
    p, q = np.nonzero((d <= 0.1) & (ids[:, None] < ids[None, :]))
    assert len(got) == len(p) and set(zip(got["a_id"], got["b_id"], strict=True)) == set(zip(ids[p].tolist(), ids[q].tolist(), strict=True))
    # 20,000 points on one spot leave a task in bounded parts
    n = 20_000
    tile = pd.DataFrame({"kind": HOME, "id": np.arange(n), "x": 1.0, "y": 1.0, "lon": 1.0, "pop": 0, "code": None, "polys": None})
    sizes = [len(part) for part, _ in zip(_probe(0.1, 20.0, True)(iter([tile])), range(20), strict=False)]
    assert len(sizes) == 20 and max(sizes) <= MOST_PAIRS * 1.1


def test_diff_of_a_key_over_many_batches(spark):
    # one key with many different rows, repeats included, beside others; small batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        a = [(1, i % 23) for i in range(200)] + [(k, k) for k in range(2, 40)]
        b = [(1, i % 23) for i in range(60)] + [(k, k if k % 9 else -k) for k in range(2, 38)] + [(50, 1)] * 30
        da, db = (spark.createDataFrame(x, "k long, v long") for x in (a, b))
        got = sorted(tuple(r) for r in diff_copies(da, db, ["k"], ["v"]).collect())
        assert got == [(9, "v"), (18, "v"), (27, "v"), (36, "v"), (38, "only_a"), (39, "only_a"), (50, "only_b")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_results_are_dropped_when_used(spark):
    import os

    from silverfold.session import drop_results

    h = hierarchy(spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "id long, parent_id long, name string"))
    job = os.path.dirname(os.path.dirname(h.inputFiles()[0].split(":", 1)[-1].replace("///", "/")))
    assert h.count() == 2 and len(os.listdir(job)) == 1  # the rounds' tables are gone already
    drop_results(h)
    assert not os.path.exists(job)
