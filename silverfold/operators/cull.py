"""Groups of files that may go: exact and near duplicates, junk, bursts, scenes.

Every operator takes rows and returns groups; nothing is changed in place. A run replaces
the last one's result by overwriting the partition of its kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverfold.functions import content
from silverfold.operators.skew import skew_join
from silverfold.operators.unionfind import components
from silverfold.session import Stages

#: Which scans have to run again after one changed (fixed order).
ORDER = ["junk", "burst", "exact", "near", "scene"]
AFTER = {"exact": ["near", "scene"], "near": ["scene"], "burst": ["scene"], "junk": [], "scene": []}


def rerun(kind: str) -> list[str]:
    """The scans to run after ``kind``, itself first, in the order their inputs ask for."""
    todo = {kind}
    for k in ORDER:
        if k in todo:
            todo |= set(AFTER[k])
    return [k for k in ORDER if k in todo]


def settled(area: Column) -> Column:
    return F.coalesce(area.isin(1, 2), F.lit(False))


def exact_groups(rows: DataFrame, hash_col: str) -> DataFrame:
    """Groups of rows of equal size and hash: ``size, hash, n, best_id, gain, closed``.

    Best: kept before others, settled before others, earliest, smallest id. A group is
    closed when all its rows are decided and exactly one is kept. Rows without a hash or of
    size 0 form no group. One pass of pre-aggregated minima, so a hot hash costs no extra.
    """
    best = F.struct((F.col("culling_flag") != 1).alias("a"), (~settled(F.col("area"))).alias("b"), F.col("taken_at").isNull().alias("c"), F.col("taken_at").alias("d"), "id")
    g = rows.where(F.col(hash_col).isNotNull() & (F.col("size") > 0)).groupBy("size", hash_col).agg(
        F.count(F.lit(1)).alias("n"), F.min(best).alias("b"), F.bool_and(F.col("culling_flag") > 0).alias("all"), F.count_if(F.col("culling_flag") == 1).alias("kept")
    )
    return g.where("n > 1").select("size", hash_col, "n", F.col("b.id").alias("best_id"), (F.col("size") * (F.col("n") - 1)).alias("gain"), (F.col("all") & (F.col("kept") == 1)).alias("closed"))


def staged_groups(rows: DataFrame, size: str, content_hash: Column, row_id: str) -> DataFrame:
    """Equal contents in two stages: only rows whose size another row shares are hashed."""
    shared = rows.groupBy(size).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(size)
    hashed = rows.join(shared, size, "left_semi").select(size, content_hash.alias("hash"), row_id)
    return hashed.groupBy(size, "hash").agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("best_id")).where("n > 1")


def confirmed_groups(rows: DataFrame, quick: str, full: Column, online: Column) -> DataFrame:
    """Exact groups by the full hash, ``size, full, n, best_id, gain, closed``: only rows that share size and quick hash with another are hashed in full.

    Rows that aren't ``online`` take no part, as they can't be read.
    """
    r = rows.where(online & F.col(quick).isNotNull() & (F.col("size") > 0))
    shared = r.groupBy("size", quick).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("size", quick)
    return exact_groups(r.join(shared, ["size", quick], "left_semi").withColumn("full", full), "full")


def twins(rows: DataFrame, keys: list[str], size: str, slack: float) -> DataFrame:
    """Rows for which another of equal ``keys`` has a different size at most ``slack`` away.

    No pair is formed: sorted by size, the nearest different sizes are the neighbours in
    the distinct sizes of the keys.
    """
    sizes = rows.where(F.col(size).isNotNull()).select(*keys, size).distinct()
    w = Window.partitionBy(*keys).orderBy(size)
    near = F.coalesce(F.col(size) - F.lag(size).over(w) <= slack, F.lit(False)) | F.coalesce(F.lead(size).over(w) - F.col(size) <= slack, F.lit(False))
    return rows.join(sizes.withColumn("__near", near).where("__near").drop("__near"), [*keys, size], "left_semi")


def twin_groups(rows: DataFrame, keys: list[str], size: str, slack: float, image_hash: Column) -> DataFrame:
    """Copies that differ in their metadata alone: twins by ``keys`` and size whose pictures are one: rows with their ``image`` hash.

    Only twins are hashed; a hash one row alone has is no group.
    """
    t = twins(rows, keys, size, slack).withColumn("image", image_hash).where("image is not null")
    many = t.groupBy("image").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("image")
    return t.join(many, "image", "left_semi")


def duplicate_families(rows: DataFrame, groups: list[tuple[DataFrame, list[str]]], full: str) -> DataFrame:
    """Duplicates of several kinds as one: ``family, n, best_id, gain, closed, reason``.

    ``groups`` holds members (with ``id``) and the columns that tell their group; groups that share a member are one family. Best, of the rows ``id, size, area, culling_flag, taken_at``: kept,
    settled, earliest, smallest id. A family is closed when all are decided and one is kept; its reason is exact if all full hashes are there and
    equal, else metadata. The gain is all bytes but the best's. A row of a group is linked to the group's first alone.
    """
    links = None
    for members, keys in groups:
        # a key of one row alone links nothing
        first = members.groupBy(*keys).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys, "a")
        e = members.select("id", *keys).join(first, keys).select("a", F.col("id").alias("b"))
        links = e if links is None else links.unionByName(e)
    member = labels(links).select(F.col("v").alias("id"), F.col("root").alias("family"))
    m = rows.join(member, "id")
    best = F.struct((F.col("culling_flag") != 1).alias("a"), (~settled(F.col("area"))).alias("b"), F.col("taken_at").isNull().alias("c"), F.col("taken_at").alias("d"), "id", "size")
    g = m.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.min(best).alias("b"), F.sum("size").alias("t"), F.bool_and(F.col("culling_flag") > 0).alias("all"), F.count_if(F.col("culling_flag") == 1).alias("kept"),
        ((F.count(full) == F.count(F.lit(1))) & (F.min(full) == F.max(full))).alias("same"),
    )
    return g.where("n > 1").select("family", "n", F.col("b.id").alias("best_id"), (F.col("t") - F.col("b.size")).alias("gain"), (F.col("all") & (F.col("kept") == 1)).alias("closed"), F.when(F.col("same"), "exact").otherwise("metadata").alias("reason"))


def neighbour_links(rows: DataFrame, keys: list[str], size: str, row_id: str, slack: float) -> DataFrame:
    """Links ``a, b`` between rows of equal ``keys`` next to each other by size and at most ``slack`` apart.

    These connect what all pairs within the slack would, with a link a row.
    """
    w = Window.partitionBy(*keys).orderBy(size, row_id)
    prev = rows.withColumn("__p", F.lag(row_id).over(w)).withColumn("__s", F.lag(size).over(w))
    return prev.where(F.col(size) - F.col("__s") <= slack).select(F.least("__p", row_id).alias("a"), F.greatest("__p", row_id).alias("b"))


def junk_reason(name: Column, directory: Column, size: Column, width: Column) -> Column:
    """Why a file is junk, or null; the first rule that holds counts. The directory is relative to its library."""
    n, d = F.lower(name), F.coalesce(F.lower(directory), F.lit(""))
    has = lambda c, *words: F.greatest(*(F.contains(c, F.lit(w)) for w in words))
    starts = lambda c, *words: F.greatest(*(F.startswith(c, F.lit(w)) for w in words))
    # fixed values: names screenshots, messengers and downloads go by
    return (
        F.when(starts(n, "screenshot", "screen shot", "스크린샷") | has(d, "screenshot", "스크린샷"), "screenshot")
        .when(F.startswith(n, F.lit("kakaotalk")) | F.contains(d, F.lit("kakaotalk")), "messenger")
        .when(F.arrays_overlap(F.split(d, "/"), F.array(*map(F.lit, ("download", "downloads", "다운로드")))), "downloaded")
        .when((size > 0) & (size < 61440) & (width.isNull() | (width <= 400)), "too_small")
    )


def bursts(rows: DataFrame, gap: int = 10, least: int = 3, most: int = 60) -> DataFrame:
    """Runs of pictures of a folder at most ``gap`` seconds apart, of ``least`` to ``most``; longer ones are left out whole.

    Best: has a sharpness, sharper (or larger where none has one), later. The gain is all
    bytes but the largest picture's. Folders are cut by UTC day first, so a hot folder is
    swept day by day; runs over midnight are joined from the days' first and last rows.
    """
    day = F.floor(F.col("taken_at") / 86400)
    w = Window.partitionBy("folder_id", "day").orderBy("taken_at", "id")
    r = rows.withColumn("day", day)
    r = r.withColumn("new", F.coalesce((F.col("taken_at") - F.lag("taken_at").over(w) > gap).cast("int"), F.lit(1)))
    r = r.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sharp = F.struct(F.col("sharpness").isNotNull().alias("a"), F.coalesce("sharpness", F.col("size").cast("double")).alias("b"), "taken_at", "id")
    part = r.groupBy("folder_id", "day", "no").agg(F.min("taken_at").alias("start_at"), F.max("taken_at").alias("end_at"), F.count(F.lit(1)).alias("n"), F.max(sharp).alias("b"), F.sum("size").alias("total"), F.max("size").alias("big"))
    line = Window.partitionBy("folder_id").orderBy("start_at", "day", "no")
    # only parts that touch a day's end can be joined, and those are one or two a day
    part = part.withColumn("again", F.coalesce((F.col("start_at") - F.lag("end_at").over(line) > gap).cast("int"), F.lit(1)))
    part = part.withColumn("run", F.sum("again").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    got = part.groupBy("folder_id", "run").agg(F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"), F.sum("n").alias("n"), F.max("b").alias("b"), F.sum("total").alias("total"), F.max("big").alias("big"))
    return got.where(F.col("n").between(least, most)).select("folder_id", "start_at", "end_at", "n", F.col("b.id").alias("best_id"), (F.col("total") - F.col("big")).alias("gain"))


#: Hashes of one key compared in one piece; a key of more is compared piece by piece.
KEY_HASHES = 500
#: Hashes that may share a key by chance; comparing so many costs less than moving the keys of more blocks.
PARTNERS = 32
#: Most blocks two hashes are asked to agree on.
MOST_AGREE = 4


def _masks(distance: int, agree: int) -> list[int]:
    """Masks, as signed longs, of which two 64-bit hashes at most ``distance`` bits apart agree on one.

    The bits are cut into distance + agree blocks; as at most ``distance`` of those differ, ``agree`` don't.
    """
    blocks = distance + agree
    cut = [range(64 * k // blocks, 64 * (k + 1) // blocks) for k in range(blocks)]
    masks = [sum(1 << i for c in some for i in c) for some in combinations(cut, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hamming_pairs(rows: DataFrame, hash_col: str, distance: int) -> DataFrame:
    """Pairs of different 64-bit hashes at most ``distance`` (1 to 8) bits apart: ``a < b, distance``. Exact.

    Cut into distance + k blocks, two such hashes agree on k blocks, so each hash has a key for every k blocks. k
    grows with the number of hashes, so that no more than PARTNERS share a key by chance and the candidates stay in
    proportion to the hashes. Hashes of crowded keys (flat pictures) get the keys of the largest k, and those of keys crowded even
    then, which agree on half of their bits, are compared piece by piece: each key's hashes are cut into
    pieces of KEY_HASHES, and every two pieces are a row of their own, so nothing is dropped and no task holds a whole key.
    """
    if not 0 < distance <= 8:
        raise ValueError("a distance of 1 to 8 bits")
    stages = Stages(rows.sparkSession, "hamming")
    h = stages.save(rows.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).cast("long").alias("h")).distinct(), n=F.count(F.lit(1)))
    n = h.seen["n"]
    near = lambda x, y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= distance)
    found = []
    agree = next((k for k in range(1, MOST_AGREE) if n <= PARTNERS * 2 ** (64 * k / (distance + k))), MOST_AGREE)
    while True:
        keyed = h.select("h", F.explode(F.array(*map(F.lit, _masks(distance, agree)))).alias("mask")).withColumn("key", F.col("h").bitwiseAND(F.col("mask")))
        # most keys are of one hash, which end here, or of two, which are the least and the largest; counts are pre-aggregated
        keys = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("k"), F.min("h").alias("a"), F.max("h").alias("b")).where("k > 1")
        keys = stages.save(keys, more=F.count_if(F.col("k") > 2), crowded=F.count_if(F.col("k") > KEY_HASHES))
        found.append(keys.where("k = 2").select("a", "b").where(near(F.col("a"), F.col("b"))))
        if not keys.seen["more"]:
            break
        met = stages.save(keyed.join(keys.where("k > 2").select("mask", "key", "k"), ["mask", "key"]))
        hs = met.where(F.col("k") <= KEY_HASHES).groupBy("mask", "key").agg(F.collect_list("h").alias("hs"))
        found.append(hs.select(F.explode("hs").alias("a"), "hs").select("a", F.explode(F.filter("hs", lambda y: near(F.col("a"), y))).alias("b")))
        if not keys.seen["crowded"]:
            break
        crowd = met.where(F.col("k") > KEY_HASHES)
        if agree == MOST_AGREE:
            found.append(_by_pieces(crowd, near))
            break
        agree, h = MOST_AGREE, stages.save(crowd.select("h").distinct())
    got = stages.save(reduce(DataFrame.unionByName, found).distinct().select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int").alias("distance")))
    stages.keep(got)
    return got


def _by_pieces(crowd: DataFrame, near) -> DataFrame:
    """Near pairs within crowded keys ``mask, key, h, k``: pieces of a key meet two by two."""
    pieces = F.ceil(F.col("k") / KEY_HASHES)
    cut = crowd.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("h"), F.col("pieces")))
    ends = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1), lambda i: F.struct(F.least(i, "own").alias("i"), F.greatest(i, "own").alias("j")))).alias("t")
    met = cut.select("mask", "key", "h", "own", ends).groupBy("mask", "key", "t").agg(F.collect_list(F.struct("h", "own")).alias("hs"))
    x, same = F.col("x"), F.col("t.i") == F.col("t.j")
    # of two pieces a hash meets those of the other; both orders are looked at
    partner = lambda y: near(x["h"], y["h"]) & (same | (y["own"] != x["own"]))
    return met.select("t", F.explode("hs").alias("x"), "hs").select(x["h"].alias("a"), F.explode(F.filter("hs", partner)).alias("y")).select("a", F.col("y.h").alias("b"))


def labels(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b``: ``v, root``, the smallest vertex of each; vertices with loops alone have no row."""
    return components(edges.where("a <> b"))


#: Rows of components that are worked through together.
BUCKET_ROWS = 20_000


def _by_component(rows: DataFrame, stages: Stages, run, schema: str) -> DataFrame:
    """Applies ``run`` to many whole components ``root`` at a time, as most are of a few rows."""
    rows = stages.save(rows, n=F.count(F.lit(1)))
    buckets = max(1, -(-rows.seen["n"] // BUCKET_ROWS))
    return rows.withColumn("__bucket", F.pmod(F.xxhash64("root"), F.lit(buckets))).groupBy("__bucket").applyInPandas(run, schema)


def _parts(sorted_roots: np.ndarray) -> Iterator[slice]:
    """The rows of each component, of rows sorted by component."""
    at = np.flatnonzero(np.append(True, sorted_roots[1:] != sorted_roots[:-1]))
    return (slice(a, b) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(sorted_roots)], strict=True))


def _seeds(aspect: float, limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Splits hashes near each other into groups of alike pictures.

        Pictures are linked where hashes are near and signatures alike; of what is linked, the
        largest picture left takes all later ones of its shape that are alike.
        """
        p = pdf.sort_values(["root", "pixels", "file_id"], ascending=[True, False, True])
        shape = p["width"].to_numpy(float) / p["height"].to_numpy(float)
        hashes, files = p["hash"].to_numpy(np.int64).view(np.uint64), p["file_id"].to_numpy(np.int64)
        signed = p["signature"].notna().any()
        sigs = content.signature_rows(p["signature"]) if signed else None
        seeds = np.empty(len(p), np.int64)
        for rows in _parts(p["root"].to_numpy()):
            ar, h, ids, n = shape[rows], hashes[rows], files[rows], rows.stop - rows.start
            sig = sigs[rows] if signed else None

            def alike(i, of, h=h, sig=sig):
                """Of the pictures ``of`` those alike to i; the costly test is made of few."""
                return of[content.alike_rows(sig[of], sig[i])] if signed else of[np.bitwise_count(h[of] ^ h[i]) <= limit]

            # what is linked to the first picture, to what is linked to it, and so on
            part, parts, left = np.full(n, -1), 0, np.arange(n)
            while len(left):
                todo = [left[0]]
                part[left[0]], left = parts, left[1:]
                while todo and len(left):
                    j = todo.pop()
                    new = alike(j, left[np.bitwise_count(h[left] ^ h[j]) <= limit])
                    part[new] = parts
                    left = left[part[left] < 0]
                    todo += new.tolist()
                parts += 1
            free, group = np.ones(n, bool), ids.copy()
            for i in range(n):
                if free[i] and parts < n:
                    # the largest first, so all that it may take come later
                    of = np.flatnonzero(free[i + 1 :] & (part[i + 1 :] == part[i]) & (np.abs(ar[i + 1 :] - ar[i]) <= aspect * ar[i])) + i + 1
                    mine = alike(i, of)
                    free[mine] = False
                    group[mine] = ids[i]
            seeds[rows] = group
        return pd.DataFrame({"file_id": files, "seed": seeds})

    return run


def near_groups(rows: DataFrame, distance: int, aspect: float = 0.02, signature: str | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Near-duplicate groups: ``seed, n, best_id, saved``.

    Pictures whose hashes are within ``distance`` bits and whose ``signature``s, where that column is
    named, are alike (see :func:`silverfold.functions.content.alike`; none is like nothing) are linked; what is linked is
    split around seeds (the largest picture takes those of its shape alike to it, no chains), and groups of one folder and one size, which are
    bursts, are left out. Best: most pixels, settled, largest, then the later id. Rows whose ``file_id`` is in ``skip``, such as
    the lesser copies of exact duplicates, take no part.

    Rows of one hash, shape and signature are one row in the clustering, so what a component holds is
    bounded by its distinct hashes, shapes and signatures, and copies join their row afterwards.
    """
    r = rows.where("hash is not null and width > 0 and height > 0")
    r = r.withColumn("signature", F.lit(None).cast("binary")) if signature is None else r.withColumn("signature", F.col(signature)).where("signature is not null")
    if skip is not None:
        r = r.join(skip.select("file_id").distinct(), "file_id", "left_anti")
    same = ["hash", "width", "height", "signature"]
    shapes = r.groupBy(*same).agg(F.min("file_id").alias("file_id"))
    comp = labels(hamming_pairs(r, "hash", distance)).select(F.col("v").alias("hash"), "root")
    s = shapes.join(comp, "hash", "left").withColumn("root", F.coalesce("root", "hash"))
    s = s.withColumn("pixels", F.col("width") * F.col("height"))
    many = s.groupBy("root").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("root")
    seeds = _by_component(s.join(many, "root", "left_semi"), Stages(rows.sparkSession, "near"), _seeds(aspect, distance), "file_id long, seed long")
    group = shapes.join(seeds, "file_id", "left").select(*(F.col(c).alias(f"__{c}") for c in same), F.coalesce("seed", "file_id").alias("seed"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same]
    m = r.join(group, on)
    best = F.struct((F.col("width") * F.col("height")).alias("p"), settled(F.col("area")).alias("s"), "size", "file_id")
    place = F.struct("folder_id", "width", "height")
    got = m.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("b"), F.sum("size").alias("t"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    return got.where("n > 1 and lo <> hi").select("seed", "n", F.col("b.file_id").alias("best_id"), (F.col("t") - F.col("b.size")).alias("saved"))


#: Rows of a block in which pictures are compared with those ahead of them.
SCENE_BLOCK = 4096


def _hits(threshold: float, span: int, ahead: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs (i, j ahead of i) alike in a block; rows of the next block only stand ahead."""
        p = pdf.sort_values("rank").reset_index(drop=True)
        v = np.stack(p["embedding"].to_numpy()).astype(np.float64)
        t, ids = p["taken_at"].to_numpy(), p["id"].to_numpy()
        got = []
        for i in np.flatnonzero(~p["copy"].to_numpy()):
            end = min(len(p), i + 1 + ahead, int(np.searchsorted(t, t[i] + span, side="right")))
            cos = v[i + 1 : end] @ v[i]
            j = np.flatnonzero(cos >= threshold)
            if len(j):
                got.append(pd.DataFrame({"a": ids[i], "b": ids[i + 1 + j], "at": p["rank"].iat[i], "to": p["rank"].to_numpy()[i + 1 + j], "cos": cos[j]}))
        return pd.concat(got) if got else pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "at": np.empty(0, np.int64), "to": np.empty(0, np.int64), "cos": np.empty(0)})

    return run


def _take(pdf: pd.DataFrame) -> pd.DataFrame:
    """The first picture in no scene takes all it hits that are in none; no chains."""
    p = pdf.sort_values(["at", "to"])
    seed: dict[int, int] = {}
    weakest: dict[int, float] = {}
    for a, b, cos in zip(p["a"].tolist(), p["b"].tolist(), p["cos"].tolist(), strict=True):
        # hits of a come together, and those of any two components do not meet; a is a seed if none before it took it
        if seed.get(a, a) == a and b not in seed:
            seed[a], seed[b] = a, a
            weakest[a] = min(cos, weakest.get(a, 2.0))
    return pd.DataFrame({"id": list(seed), "seed": list(seed.values()), "weakest": [weakest[s] for s in seed.values()]}).astype({"id": "int64", "seed": "int64", "weakest": "float64"})


def scenes(rows: DataFrame, threshold: float = 0.95, span: int = 3600, ahead: int = 200, grouped: DataFrame | None = None, block: int = SCENE_BLOCK) -> DataFrame:
    """Groups of alike pictures taken near each other: ``seed, n, best_id, gain, weakest``.

    Pictures are gone through by time and id; one in no group yet takes all later ones within
    ``span`` seconds and ``ahead`` rows whose cosine with it is ``threshold`` or more. Pictures that are in one
    group of ``grouped`` (``id, group_id``, the open groups of other scans) already are not put together again. Vectors of another
    dimension than the first picture's, and rows without a time or vector, are left out.

    Rows are numbered in order of time and compared in blocks of ``block`` rows with the ``ahead`` next ones, so
    a task is as long as its block however many pictures one hour has. Who takes whom depends only on the hits a picture
    is linked to, so each component of the hits is gone through by itself.
    """
    spark = rows.sparkSession
    stages = Stages(spark, "scenes")
    r = rows.where("id is not null and taken_at is not null and embedding is not null").select("id", F.col("taken_at").cast("long").alias("taken_at"), "embedding")
    first = r.agg(F.min(F.struct("taken_at", "id", F.size("embedding").alias("dim"))).alias("f")).select(F.col("f.dim").alias("dim"))
    r = r.join(F.broadcast(first), F.size("embedding") == F.col("dim")).drop("dim")
    # numbered by time: ranges in order, and in each the place within it
    line = r.repartitionByRange("taken_at", "id").sortWithinPartitions("taken_at", "id").withColumn("n", F.monotonically_increasing_id())
    line = stages.save(line.withColumns({"part": F.shiftright("n", 33).cast("int"), "place": F.col("n").bitwiseAND((1 << 33) - 1)}).drop("n"))
    sizes = line.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("n")
    line = line.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place"))
    at = F.floor(F.col("rank") / block)
    both = F.when((F.col("rank") % block < ahead) & (at > 0), F.array(F.struct(at.alias("block"), F.lit(False).alias("copy")), F.struct((at - 1).alias("block"), F.lit(True).alias("copy"))))
    put = F.explode(F.coalesce(both, F.array(F.struct(at.alias("block"), F.lit(False).alias("copy"))))).alias("put")
    blocks = line.select("id", "taken_at", "embedding", "rank", put).select("put.*", "id", "taken_at", "embedding", "rank")
    if ahead > block:
        raise ValueError("a block holds at least the rows ahead")
    hits = blocks.groupBy("block").applyInPandas(_hits(threshold, span, ahead), "a long, b long, at long, to long, cos double")
    if grouped is not None:
        g = grouped.where("group_id is not null").select("id", "group_id").distinct()
        hits = stages.save(hits)
        together = hits.select("a", "b").join(g.withColumnRenamed("id", "a"), "a").join(g.withColumnRenamed("id", "b"), ["b", "group_id"]).select("a", "b").distinct()
        hits = hits.join(together, ["a", "b"], "left_anti")
    hits = stages.save(hits)
    roots = labels(hits.select("a", "b")).select(F.col("v").alias("a"), "root")
    took = _by_component(hits.join(roots, "a"), stages, _take, "id long, seed long, weakest double")
    m = took.join(rows.select("id", F.col("size").cast("long").alias("size"), F.col("sharpness").cast("double").alias("sharpness"), F.col("area").cast("int").alias("area")), "id")
    best = F.struct(settled(F.col("area")).alias("s"), F.coalesce("sharpness", F.lit(0.0)).alias("q"), "size", "id")
    g = m.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("b"), F.sum("size").alias("t"), F.min("weakest").alias("weakest"))
    return g.select("seed", "n", F.col("b.id").alias("best_id"), (F.col("t") - F.col("b.size")).alias("gain"), F.round("weakest", 6).alias("weakest"))


def ranked(m: DataFrame) -> DataFrame:
    """Members with their place in the group: the best, then by score, size and id."""
    key = Window.partitionBy("group_id").orderBy(F.desc_nulls_last("is_best"), F.desc_nulls_last("score"), F.desc("size"), "file_id")
    return m.withColumn("pos", F.row_number().over(key))


def group_list(m: DataFrame, limit: int) -> DataFrame:
    """Groups by bytes, largest first, each with its first member as cover."""
    first = F.min(F.struct((~F.coalesce("is_best", F.lit(False))).alias("a"), F.col("is_best").isNull().alias("a2"), F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("b"), (-F.col("size")).alias("c"), "file_id", "name", "library"))
    g = m.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size_bytes"), first.alias("f"))
    return g.orderBy(F.desc("size_bytes"), "group_id").limit(limit).select("group_id", "n", "size_bytes", F.col("f.name").alias("cover"), F.col("f.library").alias("library"))


def apply_groups(m: DataFrame, skip_settled: bool) -> DataFrame:
    """The flags to change when each group keeps its best (settled, largest, smallest id): old and new.

    With ``skip_settled`` groups that would drop a settled file are left out, and a file
    someone kept is not dropped.
    """
    order = F.struct((~settled(F.col("area"))).alias("a"), (-F.col("size")).alias("b"), "file_id")
    g = m.groupBy("group_id").agg(F.min(order).alias("b"), F.count_if(settled(F.col("area"))).alias("k"))
    best = g.select("group_id", F.col("b.file_id").alias("best_id"), (F.col("k") - (~F.col("b.a")).cast("int")).alias("lost"))
    j = skew_join(m, best, "group_id", "inner")
    new = F.when(F.col("file_id") == F.col("best_id"), 1).otherwise(2)
    if skip_settled:
        j = j.where("lost = 0").where(~((F.col("culling_flag") == 1) & (new == 2)))
    return j.where(F.col("culling_flag") != new).select("group_id", "file_id", F.col("culling_flag").alias("old_flag"), new.alias("new_flag"))


def set_best(m: DataFrame, chosen: DataFrame) -> DataFrame:
    """``is_best`` of the members after a choice ``group_id, file_id``; a choice outside its group is ignored."""
    return m.join(chosen.select("group_id", "file_id", F.lit(True).alias("b")).distinct(), ["group_id", "file_id"], "left").select("group_id", "file_id", F.coalesce("b", F.lit(False)).alias("is_best"))


def list_groups(m: DataFrame, kind: int, done: bool, library_id: int | None, settled_only: bool, limit: int, offset: int = 0) -> DataFrame:
    """A page of the groups of a kind: ``group_id, n, size_bytes, cover``, by bytes, largest first.

    Members have ``group_id, file_id, size, area, is_best, library_id, name, kind, state`` (0 open, 1 done). With
    ``settled_only`` only groups that would drop a settled file; with a library only those of which it would lose
    one (of kind 1, junk, any). ``limit`` is brought into 1 to 200. One pass of aggregates over the members.
    """
    best = F.coalesce("is_best", F.lit(False))
    g = m.where((F.col("kind") == kind) & (F.col("state") == int(done))).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("size_bytes"), F.min(F.struct((~best).alias("a"), "file_id", "name")).alias("f"),
        F.bool_or(~best & settled(F.col("area"))).alias("settled"), F.bool_or(F.coalesce(F.col("library_id") == library_id, F.lit(False)) & ((F.col("kind") == 1) | ~best)).alias("here"),
    )
    if settled_only:
        g = g.where("settled")
    if library_id is not None:
        g = g.where("here")
    return g.orderBy(F.desc("size_bytes"), "group_id").offset(offset).limit(min(max(limit, 1), 200)).select("group_id", "n", "size_bytes", F.col("f.name").alias("cover"))


def _to_apply(m: DataFrame, kind: int, folder_id: int | None, library_id: int | None) -> DataFrame:
    """Members of the open groups of a kind in scope, each with what its group would do to settled files."""
    best = F.coalesce("is_best", F.lit(False))
    here = F.lit(True)
    for col, v in (("folder_id", folder_id), ("library_id", library_id)):
        if v is not None:
            here = here & F.coalesce(F.bool_or((F.col(col) == v) & ~best), F.lit(False))
    open_ones = m.where((F.col("kind") == kind) & (F.col("state") == 0)).withColumns({"best": best, "settled": settled(F.col("area"))})
    g = open_ones.groupBy("group_id").agg(here.alias("here"), F.bool_or(F.col("settled") & ~F.col("best")).alias("loses")).where("here").drop("here")
    return skew_join(open_ones, g, "group_id", "inner")


def apply_all(m: DataFrame, kind: int, folder_id: int | None = None, library_id: int | None = None, skip_settled: bool = False) -> DataFrame:
    """The flags that change when all open groups of a kind are applied: ``group_id, file_id, old_flag, new_flag``.

    In scope are groups that would drop a file of the folder or library. The marked best is kept, the others go, but
    none that someone kept. With ``skip_settled`` groups that would drop a settled file are left alone. Junk (kind 1) has no best: all go,
    but for settled files with ``skip_settled``.
    """
    t = _to_apply(m, kind, folder_id, library_id)
    if skip_settled:
        t = t.where("not settled" if kind == 1 else "not loses")
    new = F.lit(2) if kind == 1 else F.when(F.col("best"), 1).otherwise(2)
    changes = (F.col("culling_flag") != new) & ~((F.col("culling_flag") == 1) & (new == 2))
    return t.where(changes).select("group_id", "file_id", F.col("culling_flag").alias("old_flag"), new.alias("new_flag"))


def dry_run(m: DataFrame, kind: int, folder_id: int | None = None, library_id: int | None = None, skip_settled: bool = False) -> DataFrame:
    """What ``apply_all`` would do, in one row: ``kind, groups, kept, rejected, skipped``; skipped are groups, of junk files."""
    t = _to_apply(m, kind, folder_id, library_id)
    left = F.lit(True) if not skip_settled else ~F.col("settled") if kind == 1 else ~F.col("loses")
    group_stays = F.lit(True) if kind == 1 else left
    files_of = lambda cond: F.countDistinct(F.when(cond, F.col("file_id")))
    skipped = F.lit(0).cast("long") if not skip_settled else files_of(F.col("settled")) if kind == 1 else F.countDistinct(F.when(F.col("loses"), F.col("group_id")))
    kept = F.lit(0).cast("long") if kind == 1 else files_of(left & F.col("best"))
    rejected = files_of(left) if kind == 1 else files_of(left & ~F.col("best"))
    return t.agg(F.countDistinct(F.when(group_stays, F.col("group_id"))).alias("groups"), kept.alias("kept"), rejected.alias("rejected"), skipped.alias("skipped")).select(F.lit(kind).alias("kind"), "groups", "kept", "rejected", "skipped")


def skip(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """States of groups ``group_id, state`` when the open ones of ``chosen`` are put aside (2)."""
    c = chosen.select("group_id", F.lit(True).alias("__c")).distinct()
    return groups.join(c, "group_id", "left").select("group_id", F.when(F.col("__c") & (F.col("state") == 0), 2).otherwise(F.col("state")).alias("state"))


def reopen(m: DataFrame, unmarked: DataFrame, kind: int) -> DataFrame:
    """States of groups when files are unmarked: a closed group of the kind that has one of them is open again."""
    u = unmarked.select("file_id", F.lit(True).alias("__u")).distinct()
    g = m.join(u, "file_id", "left").groupBy("group_id").agg(F.max("state").alias("state"), F.max("kind").alias("kind"), F.bool_or(F.coalesce("__u", F.lit(False))).alias("u"))
    return g.select("group_id", F.when((F.col("state") == 1) & (F.col("kind") == kind) & F.col("u"), 0).otherwise(F.col("state")).alias("state"))
