"""Pairwise matches to groups (problem 2): union-find on a two-dimensional grid.

The matched values become vertices, whose grid of block pairs, cells and exchanges of
representatives is :mod:`silverfold.operators.unionfind`; here rows are brought to vertices and back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverfold.operators.skew import HOT_SHARE, skew_join
from silverfold.operators.unionfind import CELL_EDGES, components
from silverfold.session import Stages


def group_rows(rows: DataFrame, pairs: DataFrame, row_id: str, value: str, left: str, right: str, cell_edges: int = CELL_EDGES) -> DataFrame:
    """Rows in groups of two or more: ``row_id, group_id``, the group's smallest row id.

    Rows of equal non-null ``value`` belong together, and so do those whose values a pair
    links; pairs with a null or unknown side link nothing. Repeated rows count once.

    The vertices are not the values but the smallest row id of each value, so the root of a component is
    already its group id and no join on the group, where a hot group would meet, is needed.
    """
    stages = Stages(rows.sparkSession, "groups")
    r = rows.where(F.col(value).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("rid"), F.col(value).alias("x"))
    vert = stages.save(r.groupBy("x").agg(F.min("rid").alias("low"), F.max("rid").alias("high"), F.count(F.lit(1)).alias("n")))
    p = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(F.col(left).alias("x"), F.col(right).alias("y")).distinct()
    v = vert.select("x", F.col("low").alias("a"))
    e = skew_join(p, v, "x", "inner")
    e = skew_join(e, v.select(F.col("x").alias("y"), F.col("a").alias("b")), "y", "inner").select("a", "b")
    comp = components(e, cell_edges=cell_edges).select(F.col("v").alias("low"), "root")
    grouped = stages.save(vert.join(comp, "low", "left").where("root is not null or low <> high").select("x", F.coalesce("root", "low").alias("group_id"), "n"))
    total = vert.agg(F.sum("n")).first()[0] or 0
    hot = [x[0] for x in grouped.where(F.col("n") > max(20_000, int(total * HOT_SHARE))).select("x").collect()]
    out = skew_join(r.distinct(), grouped.select("x", "group_id"), "x", "inner", hot=hot)
    return out.select(F.col("rid").alias(row_id), "group_id")
