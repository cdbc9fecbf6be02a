"""Points near other points, regions or cities (problem 1).

A quadtree is grown from a bounded sample of the points, so that its leaves hold about
equally many. Points, regions and cities go to every leaf their search box meets; each
leaf is one group, where R-trees are bulk-loaded and probed by the points at home there.
One exchange serves all three relations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverfold.operators.rtree import RTree
from silverfold.session import plain

RADIUS_KM = 6371.0088
#: Points sampled to grow the quadtree, and points meant for a leaf.
SAMPLE, LEAF_POINTS, MAX_DEPTH = 60_000, 20_000, 18
HOME, COPY, CITY, REGION, PROBE = 0, 1, 2, 3, 4
ROW = "leaf int, salt int, kind int, id long, x double, y double, lon double, pop long, code string, polys string"
#: Copies made of rows at once, where a row of a leaf of s blocks becomes 2 s - 1; and pairs put out together.
SPREAD_ROWS, OUT_ROWS = 1_000_000, 200_000
#: Relations by their number.
RELATIONS = ["near", "in", "city"]


def haversine_km(lat1, lon1, lat2, lon2):
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def search_box(lat, km):
    """Half height and half width, in degrees, of the box that holds all within ``km``."""
    r = km / RADIUS_KM
    dy = np.degrees(r) * (1 + 1e-9) + 1e-9
    reaches_pole = np.abs(lat) + dy >= 90
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.sin(r) / np.cos(np.radians(lat))
        dx = np.where(reaches_pole | (s >= 1), 180.0, np.degrees(np.arcsin(np.minimum(s, 1.0))) * (1 + 1e-9) + 1e-9)
    return np.full_like(lat, dy), dx


def grow(lat: np.ndarray, lon: np.ndarray, leaf_sample: int) -> np.ndarray:
    """Quadtree leaves ``x0, y0, x1, y1, points``: split while more than ``leaf_sample`` lie inside."""
    leaves, todo = [], [(-180.0, -90.0, 180.0, 90.0, 0, np.arange(len(lat)))]
    while todo:
        x0, y0, x1, y1, depth, inside = todo.pop()
        if len(inside) <= leaf_sample or depth == MAX_DEPTH:
            leaves.append((x0, y0, x1, y1, len(inside)))
            continue
        xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
        right, up = lon[inside] >= xm, lat[inside] >= ym
        for r in (False, True):
            for u in (False, True):
                todo.append((xm if r else x0, ym if u else y0, x1 if r else xm, y1 if u else ym, depth + 1, inside[(right == r) & (up == u)]))
    return np.array(leaves)


class Leaves:
    """Which leaves a point or a box meets; leaves are closed below and open above."""

    def __init__(self, boxes: np.ndarray, salts: np.ndarray):
        self.boxes, self.salts = boxes, salts
        self._tree = None

    @property
    def tree(self) -> RTree:
        if self._tree is None:
            self._tree = RTree(*(np.ascontiguousarray(self.boxes[:, i]) for i in range(4)))
        return self._tree

    def __getstate__(self):
        return self.boxes, self.salts

    def __setstate__(self, s):
        self.boxes, self.salts = s
        self._tree = None

    def home(self, lat, lon):
        out = np.full(len(lat), -1, np.int64)
        for p, leaf in self.tree.pairs(lon, lat, lon, lat):
            b = self.boxes[leaf]
            x, y = lon[p], lat[p]
            mine = (b[:, 0] <= x) & (b[:, 1] <= y) & ((x < b[:, 2]) | (b[:, 2] == 180)) & ((y < b[:, 3]) | (b[:, 3] == 90))
            out[p[mine]] = leaf[mine]
        return out

    def meeting(self, x0, y0, x1, y1):
        got = list(self.tree.pairs(x0, y0, x1, y1))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2


def _spread(leaves: Leaves, near_km: float, city_km: float):
    """Sends each row to its leaves: a point to its home and as a copy to all others its box meets.

    A leaf of s blocks has s * s tiles. Tile (i, j) probes the points of block i with those of block
    j, so a point goes to the s tiles that probe it and the s that hold it; cities and regions go to the tiles (i, 0).
    """

    def place(pdf: pd.DataFrame, kind: int) -> pd.DataFrame:
        parts = []

        def put(rows, leaf, tile, kind, x):
            parts.append((rows, leaf, tile, np.full(len(rows), kind), x))

        def every(leaf):
            """Each row with each block of its leaf."""
            n = leaves.salts[leaf]
            rep = np.repeat(np.arange(len(leaf)), n)
            return rep, np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n), n[rep]

        def hold(rows, leaf, kind, x, block, but_own=False):
            rep, i, s = every(leaf)
            tile = i * s + block[rep]
            keep = i != block[rep] if but_own else slice(None)
            put(rows[rep][keep], leaf[rep][keep], tile[keep], kind, x[rep][keep])

        if kind == REGION:
            b = np.stack(pdf["bbox"].to_numpy()).astype(float)
            rows, leaf = leaves.meeting(b[:, 0], b[:, 1], b[:, 2], b[:, 3])
            hold(rows, leaf, REGION, np.zeros(len(rows)), np.zeros(len(rows), np.int64))
        else:
            lat, lon = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
            dy, dx = search_box(lat, near_km if kind == HOME else city_km)
            all_rows, x = np.arange(len(pdf)), lon
            # a box reaching over the antimeridian is also looked at from the other side
            east, west = (dx >= 180) | (lon + dx > 180), (dx >= 180) | (lon - dx < -180)
            rows = np.concatenate([all_rows, all_rows[east], all_rows[west]])
            x = np.concatenate([lon, lon[east] - 360, lon[west] + 360])
            at, leaf = leaves.meeting(x - dx[rows], lat[rows] - dy[rows], x + dx[rows], lat[rows] + dy[rows])
            if kind == CITY:
                hold(rows[at], leaf, CITY, x[at], np.zeros(len(at), np.int64))
            else:
                ids, home = pdf["id"].to_numpy(np.int64), leaves.home(lat, lon)
                own = ids % leaves.salts[home]
                put(all_rows, home, own * leaves.salts[home] + own, HOME, lon)
                parted = leaves.salts[home] > 1
                if parted.any():
                    r, at_home = all_rows[parted], home[parted]
                    rep, j, s = every(at_home)
                    other = j != own[r][rep]
                    put(r[rep][other], at_home[rep][other], (own[r][rep] * s + j)[other], PROBE, lon[r][rep][other])
                    hold(r, at_home, COPY, lon[r], own[r], but_own=True)
                away = ~((leaf == home[rows[at]]) & (at < len(pdf)))
                at, leaf = at[away], leaf[away]
                hold(rows[at], leaf, COPY, x[at], ids[rows[at]] % leaves.salts[leaf])
        rows, leaf, tile, kinds, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        out = pdf[["id", "lat", "lon", "pop", "code", "polys"]].take(rows).rename(columns={"lat": "y"})
        out = out.assign(leaf=leaf.astype(np.int32), salt=tile.astype(np.int32), kind=kinds.astype(np.int32), x=x)
        return plain(out)[["leaf", "salt", "kind", "id", "x", "y", "lon", "pop", "code", "polys"]]

    step = max(100, int(SPREAD_ROWS // (2 * leaves.salts.max(initial=1))))

    def run(batches):
        for pdf in batches:
            for kind in (HOME, CITY, REGION):
                part = pdf[pdf["kind"] == kind]
                for lo in range(0, len(part), step):
                    yield place(part.iloc[lo : lo + step].reset_index(drop=True), kind)

    return run


def inside(px, py, polys) -> np.ndarray:
    """Whether points lie in the region: in a polygon's outer ring and in none of its holes."""
    out = np.zeros(len(px), bool)
    for rings in polys:
        odd = np.zeros(len(px), bool)
        for ring in rings:
            r = np.stack([np.asarray(v, float) for v in ring])
            ax, ay = r[:, 0], r[:, 1]
            bx, by = np.roll(ax, -1), np.roll(ay, -1)
            for lo in range(0, len(px), 8192):
                y, x = py[lo : lo + 8192, None], px[lo : lo + 8192, None]
                spans = (ay > y) != (by > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    cross = x < (bx - ax) * (y - ay) / (by - ay) + ax
                odd[lo : lo + 8192] ^= ((spans & cross).sum(axis=1) % 2).astype(bool)
        out |= odd
    return out


def _gathered(parts: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Rows ``rel, a_id, b_id, km`` in frames of about OUT_ROWS, from many smaller parts."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[1])
        if n >= OUT_ROWS:
            yield _frame(held)
            held, n = [], 0
    if n:
        yield _frame(held)


def _frame(parts: list[tuple]) -> pd.DataFrame:
    rel = np.repeat(np.array([p[0] for p in parts], np.int32), [len(p[1]) for p in parts])
    return pd.DataFrame({"rel": rel, **{c: np.concatenate([p[i] for p in parts]) for i, c in ((1, "a_id"), (2, "b_id"), (3, "km"))}})


def _probe(near_km: float, city_km: float, near: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _gathered(relations(batches))

    def relations(batches):
        held = list(batches)
        pdf = held[0] if len(held) == 1 else plain(pd.concat(held, ignore_index=True))
        kind = pdf["kind"].to_numpy()
        ids, x, y = pdf["id"].to_numpy(), pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        lon = pdf["lon"].to_numpy(float)
        home = np.flatnonzero((kind == HOME) | (kind == PROBE))
        if not len(home):
            return

        def hits(build, km):
            dy, dx = search_box(y[home], km)
            tree = RTree(x[build], y[build], x[build], y[build])
            for p, b in tree.pairs(x[home] - dx, y[home] - dy, x[home] + dx, y[home] + dy):
                p, b = home[p], build[b]
                yield p, b, haversine_km(y[p], lon[p], y[b], lon[b])

        if near:
            build = np.flatnonzero(kind <= COPY)
            twice = (x[build] != lon[build]).any()
            for p, b, d in hits(build, near_km):
                # the pair belongs to the leaf where its reference point, the smaller id, is at home
                ok = (d <= near_km) & (ids[p] < ids[b])
                p, b, d = ids[p[ok]], ids[b[ok]], d[ok]
                if twice and len(p):
                    # seen from both sides of the antimeridian
                    at = pd.DataFrame({"p": p, "b": b}).drop_duplicates().index.to_numpy()
                    p, b, d = p[at], b[at], d[at]
                yield 0, p, b, d
        codes = []
        reg = np.flatnonzero(kind == REGION)
        if len(reg):
            polys = {r: json.loads(pdf["polys"].iat[r]) for r in reg}
            code, level = pdf["code"].to_numpy(), pdf["pop"].to_numpy()

            def box(r):
                v = np.concatenate([np.stack([np.asarray(p, float) for p in ring]) for rings in polys[r] for ring in rings])
                return (*v.min(axis=0), *v.max(axis=0))

            tree, boxes = RTree(x[home], y[home], x[home], y[home]), np.array([box(r) for r in reg])
            for which, at in tree.pairs(*(np.ascontiguousarray(boxes[:, i]) for i in range(4)), block=1):
                r, cand = reg[which[0]], home[at]
                cand = cand[inside(x[cand], y[cand], polys[r])]
                yield 1, ids[cand], np.full(len(cand), ids[r]), np.zeros(len(cand))
                if level[r] == 1:
                    codes.append(pd.DataFrame({"p": cand, "code": code[r]}))
        cities = np.flatnonzero(kind == CITY)
        if len(cities) and codes:
            lies = pd.concat(codes)
            code, pop = pdf["code"].to_numpy(), pdf["pop"].to_numpy()
            for p, b, d in hits(cities, city_km):
                ok = d <= city_km
                c = pd.DataFrame({"p": p[ok], "code": code[b[ok]], "km": d[ok], "pop": pop[b[ok]], "id": ids[b[ok]]}).merge(lies, on=["p", "code"])
                # all candidates of a probe are in one part
                c = c.sort_values(["km", "pop", "id"], ascending=[True, False, True]).drop_duplicates("p")
                yield 2, ids[c["p"].to_numpy(np.int64)], c["id"].to_numpy(np.int64), c["km"].to_numpy(float)

    return run


def nearby(points: DataFrame, regions: DataFrame | None = None, cities: DataFrame | None = None, near_km: float | None = 0.1, city_km: float = 20.0, leaf_points: int = LEAF_POINTS, sample: int = SAMPLE) -> DataFrame:
    """Relations of points ``id, lat, lon``: rows ``rel, a_id, b_id, km``.

    ``near``: two points at most ``near_km`` apart, a_id < b_id (none if near_km is None);
    ``in``: point a_id lies in region b_id of ``regions`` (``id, code, level, bbox, polys``), km 0;
    ``city``: b_id is the nearest of ``cities`` (``id, lat, lon, code, pop``), at most
    ``city_km`` away, whose code is that of a level-1 region the point lies in (equal
    distance: larger pop, then smaller id).

    Points with a null, NaN or out-of-range coordinate, or a null id, take no part, nor do
    such cities and regions without a box or polygon. Of several rows of one id the one with the smallest (lat,
    lon) is taken. A null pop counts as 0. Other columns are ignored. Empty tables give no rows.

    A leaf with far more than ``leaf_points`` points (one spot holding much of the data) is
    cut into blocks, and each pair of blocks is a task's group of its own, so none holds more than
    two blocks and what lies around them; pairs leave a task as they are found. n points of a leaf are copied about
    n / leaf_points times, against the n * n / 2 pairs they may have. Only the sample and the leaf boxes, both bounded
    by ``sample``, pass through the driver. Pairs are output as asked; a spot with n points has n*(n-1)/2 of them.
    """
    spark = points.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        return df.where("id is not null and lat between -90 and 90 and lon between -180 and 180 and not isnan(lat) and not isnan(lon)")

    good = valid(points.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))
    n = good.count()
    fraction = min(1.0, sample / max(n, 1))
    got = good.select("lat", "lon").sample(fraction, seed=7).toPandas()
    per = max(n, 1) / max(len(got), 1)
    boxes = grow(got["lat"].to_numpy(), got["lon"].to_numpy(), max(8, int(leaf_points / per)))
    salts = np.maximum(1, np.ceil(boxes[:, 4] * per / (2 * leaf_points))).astype(np.int64)
    leaves = Leaves(boxes, salts)

    once = good.groupBy("id").agg(F.min(F.struct("lat", "lon")).alias("s")).select("id", "s.lat", "s.lon")
    none = {"pop": F.lit(None).cast("long"), "code": F.lit(None).cast("string"), "polys": F.lit(None).cast("string"), "bbox": F.lit(None).cast("array<double>"), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "id", *((F.col(c) if c in df.columns else none[c]).alias(c) for c in ("lat", "lon", "pop", "code", "polys", "bbox")))

    rows = shaped(once, HOME)
    if cities is not None:
        c = valid(cities.select(F.col("id").cast("long").alias("id"), "lat", "lon", "code", F.coalesce(F.col("pop").cast("long"), F.lit(0)).alias("pop")))
        rows = rows.unionByName(shaped(c.distinct(), CITY))
    if regions is not None:
        r = regions.where("id is not null and bbox is not null and size(bbox) = 4 and polys is not null and size(polys) > 0")
        rows = rows.unionByName(shaped(r.select(F.col("id").cast("long").alias("id"), "code", F.col("level").cast("long").alias("pop"), F.to_json("polys").alias("polys"), "bbox").dropDuplicates(["id"]), REGION))
    spread = rows.mapInPandas(_spread(leaves, near_km or 0.0, city_km), ROW)
    found = spread.groupBy("leaf", "salt").applyInPandas(_probe(near_km or 0.0, city_km, near_km is not None), "rel int, a_id long, b_id long, km double")
    return found.select(F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("rel") + 1).alias("rel"), "a_id", "b_id", "km")
