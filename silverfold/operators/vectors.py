"""Vectors: exact nearest by cosine, pooling, centroid clustering, box suppression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """To length 1; a zero vector stays zero."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def similar(vectors: DataFrame, query_id: int, k: int) -> DataFrame:
    """The ``k`` (1 to 200) vectors of highest cosine with one of them: ``id, score``; ties to the smaller id.

    Vectors are of length 1. Those of another dimension, and the query itself, are left
    out; an unknown id gives no rows. Each partition keeps its own k before anything moves.
    """
    q = vectors.where(F.col("id") == query_id).select(F.col("embedding").alias("q")).limit(1)
    got = vectors.where(F.col("id") != query_id).join(F.broadcast(q), F.size("embedding") == F.size("q"))
    return got.select("id", dot(F.col("embedding"), F.col("q")).alias("score")).orderBy(F.desc("score"), "id").limit(min(max(k, 1), 200))


#: Vectors of a tile.
TILE_ROWS = 32_768


def _best(qi: np.ndarray, qm: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int):
    """The k best of ``ids`` for each query, a few hundred queries at a time; of equal scores the smaller ids."""
    by = np.argsort(ids, kind="stable")
    ids, m = ids[by], m[by]
    for lo in range(0, len(qi), 256):
        q = qi[lo : lo + 256]
        s = qm[lo : lo + 256] @ m.T
        s[q[:, None] == ids[None, :]] = -np.inf
        least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
        above, level = s > least[:, None], s == least[:, None]
        # of those level with the last place as many as are wanted, by id
        take = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        r, c = np.nonzero(take & np.isfinite(s))
        yield pd.DataFrame({"q_id": q[r], "id": ids[c], "score": s[r, c].astype(np.float64)})


def nearest_of_set(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k nearest of each query over all vectors: ``q_id, id, score``, exact.

    Up to ``block`` queries are sent to all tasks, and meet every partition of the vectors as a matrix product. More are
    cut into blocks, and so are the vectors; each pair of blocks is a tile of its own on some executor, so nothing but the number of
    queries reaches the driver. Only each tile's best k a query move on.
    """
    from pyspark.sql import Window

    schema = "q_id long, id long, score double"
    n = queries.count()
    v = vectors.select("id", "embedding")
    if n <= block:
        part = queries.select(F.col("id").alias("q_id"), F.col("embedding").alias("q")).toPandas()
        if not len(part):
            return vectors.sparkSession.createDataFrame([], schema)
        sent = vectors.sparkSession.sparkContext.broadcast((part["q_id"].to_numpy(), np.stack(part["q"].to_numpy()).astype(np.float32)))

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield from _best(*sent.value, pdf["id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(np.float32), k)

        out = v.mapInPandas(run, schema)
    else:
        rows, columns = -(-n // block), max(1, -(-v.count() // TILE_ROWS))
        own = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        q = queries.select(F.lit(True).alias("asks"), own(rows).alias("i"), every(columns).alias("j"), "id", "embedding")
        t = q.unionByName(v.select(F.lit(False).alias("asks"), every(rows).alias("i"), own(columns).alias("j"), "id", "embedding"))

        def tile(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf["asks"].to_numpy()
            if asks.all() or not asks.any():
                return pd.DataFrame({"q_id": [], "id": [], "score": []}).astype({"q_id": "int64", "id": "int64", "score": "float64"})
            m, ids = np.stack(pdf["embedding"].to_numpy()).astype(np.float32), pdf["id"].to_numpy()
            return pd.concat(list(_best(ids[asks], m[asks], ids[~asks], m[~asks], k)))

        out = t.groupBy("i", "j").applyInPandas(tile, schema)
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def mean_pool(tokens: np.ndarray, mask: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Sentence vector of token vectors: mean over the mask (at most 128), projected, of length 1."""
    m = mask[:128].astype(float)
    v = (tokens[:128] * m[:, None]).sum(axis=0) / max(m.sum(), 1e-9)
    out = dense @ v
    n = np.linalg.norm(out)
    return out / n if n else out


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """The mean vector of each key, of length 1: ``key, vector``. Sums are pre-aggregated by place, so a hot key costs no more than its places."""
    at = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"))  # as long as a vector
    return v.select(key, normalize(F.col("v.m")).alias("vector"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def sentence_vector(tokens: pd.Series, mask: pd.Series, dense: pd.Series) -> pd.Series:
    """:func:`mean_pool` over columns: token vectors (an array of arrays), their mask, and the rows of the projection."""
    matrix: dict[int, np.ndarray] = {}

    def one(t, m, d):
        if t is None or m is None or d is None or not len(t):
            return None
        if id(d) not in matrix:
            matrix.clear()
            matrix[id(d)] = np.stack([np.asarray(r, float) for r in d])
        return mean_pool(np.stack([np.asarray(r, float) for r in t]), np.asarray(m), matrix[id(d)])

    return pd.Series([one(t, m, d) for t, m, d in zip(tokens, mask, dense, strict=True)])


def people_list(faces: DataFrame, files: DataFrame, thumbs: DataFrame) -> DataFrame:
    """People with their faces and, as cover, the widest face (``bbox`` is JSON with ``w``) on a live file that has a thumbnail."""
    live = files.where("trashed_at is null").select(F.col("id").alias("file_id"))
    shown = live.join(thumbs.where("state = 1").select("file_id"), "file_id", "left_semi").select("file_id", F.lit(True).alias("shown")).distinct()
    f = faces.where("person_id is not null").join(files.select(F.col("id").alias("file_id")).distinct(), "file_id", "left_semi").join(shown, "file_id", "left")
    w = F.get_json_object("bbox", "$.w").cast("double")
    cover = F.max(F.when(F.col("shown"), F.struct(w.alias("w"), (-F.col("face_id")).alias("f"))))
    return f.groupBy("person_id").agg(F.count(F.lit(1)).alias("faces"), cover.alias("m")).select("person_id", "faces", (-F.col("m.f")).alias("cover"))


def rename_people(people: DataFrame, names: DataFrame) -> DataFrame:
    """People ``person_id, name`` after new names; a blank one is no name, one not named keeps its own."""
    n = names.select("person_id", F.nullif(F.trim("name"), F.lit("")).alias("__n"), F.lit(True).alias("__there"))
    return people.join(n, "person_id", "left").select("person_id", F.when(F.col("__there"), F.col("__n")).otherwise(F.col("name")).alias("name"))


def merge_people(faces: DataFrame, merges: DataFrame) -> DataFrame:
    """Faces after merges ``from_id, to_id``, one step each: the faces of one person go to the other."""
    m = merges.select(F.col("from_id").alias("person_id"), F.col("to_id").alias("__to")).distinct()
    return faces.join(m, "person_id", "left").withColumn("person_id", F.coalesce("__to", "person_id")).drop("__to")


class _Centroids:
    """Moving centroids of length 1, to which faces are added one after the other."""

    def __init__(self, threshold: float):
        self.threshold, self.n, self.size, self.names = threshold, 0, [], {}
        self.at = np.empty((64, 0))

    def _found(self, v: np.ndarray) -> int:
        if not self.n:
            self.at = np.empty((64, len(v)))
        elif self.n == len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
        self.at[self.n] = v
        self.size.append(1)
        self.n += 1
        return self.n - 1

    def _join(self, c: int, v: np.ndarray) -> int:
        x = self.at[c] * self.size[c] + v
        n = np.linalg.norm(x)
        self.at[c] = x / n if n else x
        self.size[c] += 1
        return c

    def named(self, person, v: np.ndarray) -> int:
        if person in self.names:
            return self._join(self.names[person], v)
        self.names[person] = self._found(v)
        return self.names[person]

    def loose(self, v: np.ndarray) -> int:
        if self.n:
            s = self.at[: self.n] @ v
            c = int(s.argmax())
            if s[c] >= self.threshold:
                return self._join(c, v)
        return self._found(v)


def _people(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, known = None, None
        for pdf in batches:
            who = np.empty(len(pdf), np.int64)
            for i, (p, person, v) in enumerate(zip(pdf["__part"], pdf["person_id"], pdf["embedding"], strict=True)):
                if known is None or p != part:
                    part, known = p, _Centroids(threshold)
                v = np.asarray(v, np.float64)
                who[i] = known.loose(v) if pd.isna(person) else known.named(person, v)
            yield pd.DataFrame({"id": pdf["id"], "cluster": who})

    return run


def people(faces: DataFrame, threshold: float = 0.5, key: str = "part") -> DataFrame:
    """Faces ``part, id, person_id (null if new), embedding`` to clusters ``id, cluster``, in the order of ids.

    Named faces come first and form the persons' centroids. A loose face joins the nearest centroid of
    ``threshold`` or more, which moves towards it, or founds one. What a face joins depends on all before it, so a part is one task, which
    reads its faces in order and holds the centroids alone, not the faces; split by anything no
    person crosses, such as a library, before. Faces without a vector are left out.
    """
    # an integer key in Spark's own hashing keeps each part whole and in order within one task
    f = faces.where("embedding is not null").withColumnRenamed(key, "__part").select("__part", "id", "person_id", F.col("embedding").cast("array<double>").alias("embedding"))
    line = f.repartition("__part").sortWithinPartitions("__part", F.col("person_id").isNull(), "id")
    return line.mapInPandas(_people(threshold), "id long, cluster long")


def suppress(boxes: pd.DataFrame, least: float = 0.8, overlap: float = 0.3) -> pd.DataFrame:
    """Faces out of detections ``x, y, w, h, cls, obj`` of one picture: score sqrt(cls * obj) of ``least`` or more,
    best first, without those overlapping a better one by more than ``overlap`` (intersection over union)."""
    b = boxes.assign(score=np.sqrt(boxes["cls"] * boxes["obj"]))
    b = b[b["score"] >= least].sort_values("score", ascending=False, kind="stable").reset_index(drop=True)
    x, y, w, h = (b[c].to_numpy(float) for c in "xywh")
    left, keep = np.ones(len(b), bool), []
    for i in range(len(b)):
        if left[i]:
            keep.append(i)
            iw = np.minimum(x[i] + w[i], x + w) - np.maximum(x[i], x)
            ih = np.minimum(y[i] + h[i], y + h) - np.maximum(y[i], y)
            inter = np.maximum(iw, 0) * np.maximum(ih, 0)
            union = w[i] * h[i] + w * h - inter
            left &= ~((union > 0) & (inter > overlap * union))
    return b.iloc[keep]


def faces_of(detections: DataFrame, picture: str, least: float = 0.8, overlap: float = 0.3) -> DataFrame:
    """:func:`suppress` for each picture of detections ``picture, x, y, w, h, cls, obj``; a picture's detections are bounded by the detector's grid."""
    cols = [c for c in detections.columns if c != picture]
    schema = f"{picture} {dict(detections.dtypes)[picture]}, " + ", ".join(f"{c} {t}" for c, t in detections.dtypes if c in cols) + ", score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return suppress(pdf, least, overlap)[[picture, *cols, "score"]]

    return detections.where((F.col("cls") >= 0) & (F.col("obj") >= 0)).groupBy(picture).applyInPandas(run, schema)
