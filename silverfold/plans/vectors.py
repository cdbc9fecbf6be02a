"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverfold.operators import vectors as v
from silverfold.plans.registry import query
from silverfold.session import table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query("v01_similar", "WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> 7 ORDER BY list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20")
def similar(spark, d):
    return v.similar(_vectors(spark, d), 7, 20).withColumn("score", F.round("score", 6))


@query("v01_nearest_of_set", """WITH p AS (SELECT a.vec_id AS q_id, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS r FROM p) SELECT q_id, id, round(s, 4) AS score FROM r WHERE r <= 10""")
def nearest(spark, d):
    """The ten nearest of every row whose id is divisible by 50, over all rows."""
    all_rows = _vectors(spark, d)
    return v.nearest_of_set(all_rows, all_rows.where("id % 50 = 0"), 10).withColumn("score", F.round("score", 4))


@query("v02_normalize", "SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS before, CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS after FROM embeddings")
def normalize(spark, d):
    """Lengths of the vectors before and after they are brought to length 1."""
    e = F.col("embedding")
    n = v.normalize(e)
    return _vectors(spark, d).select("id", F.round(F.sqrt(v.dot(e, e)), 4).alias("before"), F.round(F.sqrt(v.dot(n, n)), 4).alias("after"))


@query("v04_people")
def people(spark, d):
    """Vectors clustered around moving centroids, in the order of their ids; every tenth has a name already."""
    named = F.when(F.col("id") % 10 == 0, F.col("label").cast("long"))
    return v.people(_vectors(spark, d).select(F.lit(0).alias("part"), "id", named.alias("person_id"), "embedding"), 0.35)


@query("q23_counts", "SELECT count(*) AS vectors, count(DISTINCT label) AS people, count(*) FILTER (label IS NULL) AS loose, (SELECT count(*) FROM (SELECT DISTINCT id, trashed_at, kind FROM files) WHERE trashed_at IS NULL AND kind <> 1) AS embeddable FROM embeddings")
def counts(spark, d):
    from silverfold.plans.browse import files

    e = _vectors(spark, d).agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("label").alias("people"), F.count_if(F.col("label").isNull()).alias("loose"))
    n = files(spark, d, "kind").where("trashed_at is null and kind <> 1").agg(F.count(F.lit(1)).alias("embeddable"))
    return e.withColumn("k", F.lit(0)).join(n.withColumn("k", F.lit(0)), "k").drop("k")
