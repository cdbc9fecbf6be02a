"""Connected components of billions of edges: union-find on a two-dimensional grid.

Vertices are hashed into B blocks and each edge goes to the cell (block of one end, block of
the other), so even a vertex that a third of all edges touch is spread over B cells. Each
cell runs union-find over its own edges. Then the representatives of a vertex meet from
its row and column of cells; the vertex takes the smallest as its parent, and the others
are linked to that one in the next, smaller grid. Parents are stable once no edge is left.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverfold.operators.skew import skew_join
from silverfold.session import Stages

#: Edges a cell of the grid holds on average; the grid grows with the edges.
CELL_EDGES = 400_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (a, b), and of each the smallest vertex linked to it; in whole arrays.

    In each round every root hooks onto the smallest root an edge joins it to, and all
    paths are then shortened to their root. A root without a smaller neighbour stays, and its neighbours, being
    larger, hook; so each round at least halves the parts that are not whole yet.
    """
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(ids))
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        apart = low != high
        low, high = low[apart], high[apart]
        # ids are sorted, so the smaller index is the smaller vertex; the last write, the smallest, stays
        order = np.lexsort((-low, high))
        parent[high[order]] = low[order]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        u, v = parent[low], parent[high]
    return ids, ids[parent]


def _cell(pdf: pd.DataFrame) -> pd.DataFrame:
    v, rep = union_find(pdf["u"].to_numpy(), pdf["v"].to_numpy())
    return pd.DataFrame({"v": v, "rep": rep})


def components(edges: DataFrame, a: str = "a", b: str = "b", cell_edges: int = CELL_EDGES) -> DataFrame:
    """Every vertex of an edge with the smallest vertex linked to it: ``v, root``.

    Edges with a null end are left out; either order, repeats and loops do no harm, and a
    vertex with loops alone is its own root. No edges give no rows. Other columns are
    ignored. Rounds are about the logarithm of the diameter over the grid's cells; each
    round's tables are written to the shared folder, so a lost executor costs its tasks only.
    """
    stages = Stages(edges.sparkSession, "components")
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    given = stages.save(edges.where(u.isNotNull() & v.isNotNull()).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), n=F.count_if(F.col("u") != F.col("v")))
    loops = given.where("u = v").select("v")
    graph, n = given.where("u <> v"), given.seen["n"]
    parents: list[DataFrame] = []
    while n:
        side = max(1, math.ceil(math.sqrt(n / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
        cells = graph.withColumn("i", block("u")).withColumn("j", block("v"))
        reps = stages.save(cells.groupBy("i", "j").applyInPandas(_cell, "v long, rep long"))
        if side == 1:
            # one cell has seen every edge: its representatives are the roots
            parents.append(reps.select("v", F.col("rep").alias("p")))
            break
        low = stages.save(reps.groupBy("v").agg(F.min("rep").alias("p")))
        parents.append(low)
        # the other representatives of a vertex are linked to its smallest
        links = reps.join(low, "v").select("rep", "p").where("rep <> p").select(F.least("rep", "p").alias("u"), F.greatest("rep", "p").alias("v")).distinct()
        fresh = stages.save(links, n=F.count(F.lit(1)))
        if graph is not given:
            stages.drop(graph)
        stages.drop(reps)
        graph, n = fresh, fresh.seen["n"]
    if not parents:
        return loops.select("v", F.col("v").alias("root"))
    # a parent of one round is a vertex of the next or a root; from the last round backwards
    root = parents[-1].select("v", F.col("p").alias("root"))
    for low in reversed(parents[:-1]):
        up = root.select(F.col("v").alias("p"), F.col("root").alias("r"))
        root = stages.save(skew_join(low, up, "p", "left").select("v", F.coalesce("r", "p").alias("root")))
    alone = loops.join(root, "v", "left_anti").select("v", F.col("v").alias("root"))
    result = stages.save(root.unionByName(alone))
    stages.keep(result)
    return result
