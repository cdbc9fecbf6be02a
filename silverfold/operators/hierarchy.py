"""Parent-child rows to full hierarchies (problem 3), by heavy-path decomposition.

Only longs travel through the logarithmic pointer rounds; names move twice, once to form
the segments of the heavy chains and once to join the few chain prefixes to the nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from silverfold.operators.skew import prefix_sums, skew_join
from silverfold.session import Stages

MAX_ROUNDS = 64
#: Rows a task of a round takes at least; rounds over few rows are not cut into many tasks.
TASK_ROWS = 250_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    """As many tasks as the rows are worth; no exchange."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def _whole(tables: list[DataFrame], pointer: str) -> DataFrame:
    """All nodes as they are now: those that ended in any round, and what the last round left."""
    parts = [t.where(F.col(pointer).isNull()) for t in tables] + [tables[-1].where(F.col(pointer).isNotNull())]
    return reduce(DataFrame.unionByName, parts)


def _climb(linked: DataFrame, n: int, stages: Stages, sizes: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Pointer doubling of ``v, ptr`` (ptr null at a root) until only loops are left.

    Returns the rounds' tables ``v, ptr, dist, size, root, depth``, ended nodes having a null ptr, and the subtree sizes ``v, size``.

    After round k a node knows its ancestor 2^k up, or its root and depth. Nodes at
    depth 2^k and more stay active; as depths under a root leave no gap, a round in which
    none ends means that the rest never reaches a root. A round writes its active nodes
    alone, in one job that also counts what is left; ended nodes stay where they are and are
    read from there. ``size`` counts the nodes fewer than 2^k below: those 2^k and more below are
    counted by their 2^k-th ancestor, so the whole size of any node is 1 and what pointed to it in any round.
    A pointer many nodes share is split by the adaptive join, the other side being unique.
    """
    one, ended = F.lit(1).cast("long"), F.col("ptr").isNull()
    state = linked.select("v", "ptr", one.alias("dist"), one.alias("size"), F.when(ended, F.col("v")).alias("root"), F.when(ended, F.lit(0).cast("long")).alias("depth"))
    tables = [stages.save(_few(state, n), left=F.count_if(~ended))]
    left, old = tables[0].seen["left"], -1
    for _ in range(MAX_ROUNDS):
        if not left or left == old:
            break
        active = grown = _few(tables[-1].where("ptr is not null"), left)
        if sizes:
            below = active.groupBy(F.col("ptr").alias("v")).agg(F.sum("size").alias("more"))
            grown = active.join(below, "v", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0).cast("long")))
        up = _few(_whole(tables, "ptr"), n).select(F.col("v").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("dist").alias("dist2"))
        moved = grown.join(up, "ptr").select(
            "v", F.col("ptr2").alias("ptr"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), "size", F.col("root2").alias("root"), (F.col("dist") + F.col("depth2")).alias("depth")
        )
        tables.append(stages.save(_few(moved, left), left=F.count_if(~ended)))
        left, old = tables[-1].seen["left"], left
    if not sizes:
        return tables, None
    pointed = reduce(DataFrame.unionByName, [t.where("ptr is not null").select(F.col("ptr").alias("v"), "size") for t in tables])
    return tables, _few(pointed, n).groupBy("v").agg((F.sum("size") + 1).alias("size"))


def _loops(loops: DataFrame, n: int, stages: Stages) -> DataFrame:
    """Of nodes that never reach a root (``v, parent``): the nodes on cycles, with the
    smallest id of each cycle, ``v, root``.

    The image of the 2^k-th parent shrinks to the nodes on cycles, and is those once a
    doubling leaves its size as it is; the minima over 2^k steps are final once a
    doubling changes none of them.
    """
    state = stages.save(loops.select("v", F.col("parent").alias("ptr"), F.least("v", "parent").alias("low"), F.lit(True).alias("lower")))
    # image of f^(2^k) and minima over f^0..f^(2^k), round by round
    size, lower = -1, True
    for _ in range(MAX_ROUNDS):
        image = state.select(F.col("ptr").alias("v")).distinct()
        old, size = size, image.count()
        if size == old and not lower:
            return stages.save(state.join(image, "v", "left_semi").select("v", F.col("low").alias("root")))
        up = state.select(F.col("v").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        moved = state.join(up, "ptr").select("v", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("lower"))
        fresh = stages.save(_few(moved, n), lower=F.count_if("lower"))
        stages.drop(state)
        state, lower = fresh, fresh.seen["lower"] > 0
    raise RuntimeError("a cycle is longer than 2^64 steps")


def hierarchy(rows: DataFrame, node: str = "id", parent: str = "parent_id", name: str = "name", sep: str = "/", intervals: bool = False, paths: bool = True) -> DataFrame:
    """Each node's place in its tree: ``node, link_kind, root_id, depth, full_path, n_desc``.

    ``tree``: the parents end at a root, a node whose parent is null or no node's id.
    ``cycle``: the node is its own ancestor; ``tail``: its parents end in a cycle. For
    these root_id is the smallest id on the cycle, depth the steps to the cycle,
    full_path empty and n_desc -1.

    With ``intervals``, ``pre`` and ``last`` are added: all nodes below v are those of
    its tree with pre(v) < pre <= last(v), so a descendant set of any size is one range.
    Both are null for cycles and tails. Without ``paths`` no name is moved and full_path is null on trees.

    Rows with a null node id are left out. Of several rows with one id the one with the
    smallest (parent, name) is taken, null last. A null name joins as an empty text; a
    self-parent is a cycle of one. An empty table gives no rows. Other columns are
    ignored, whatever their names. Paths are as long as the depth; a chain of a million
    nodes has paths of a million names, which no plan can shorten.
    """
    spark = rows.sparkSession
    stages = Stages(spark, "hierarchy")
    raw = rows.select(F.col(node).cast("long").alias("v"), F.col(parent).cast("long").alias("p"), F.col(name).cast("string").alias("nm")).where("v is not null")
    best = F.struct(F.col("p").isNull().alias("pn"), F.coalesce("p", F.lit(0).cast("long")).alias("p"), F.coalesce("nm", F.lit("")).alias("nm"))
    nodes = stages.save(raw.groupBy("v").agg(F.min(best).alias("b")).select("v", F.when(~F.col("b.pn"), F.col("b.p")).alias("p"), F.col("b.nm").alias("nm")))
    known = nodes.select(F.col("v").alias("p"), F.lit(True).alias("known"))
    linked = stages.save(nodes.join(known, "p", "left").select("v", F.when(F.col("known"), F.col("p")).alias("ptr"), *(["nm"] if paths else [])), n=F.count(F.lit(1)))
    n = linked.seen["n"]

    tables, sizes = _climb(linked, n, stages, sizes=True)
    lost = tables[-1].where("ptr is not null").select("v")
    tree = _few(_ended(tables, "ptr"), n).select("v", "root", "depth").join(sizes, "v", "left").withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    off_tree = None
    if left := tables[-1].seen["left"]:
        lost = stages.save(_few(lost.join(linked, "v").select("v", F.col("ptr").alias("parent")), left))
        ring = _loops(lost, left, stages)
        cut = lost.join(ring.withColumn("on", F.lit(True)), "v", "left").select("v", F.when(F.col("on").isNull(), F.col("parent")).alias("ptr"))
        tails, _ = _climb(cut, left, stages, sizes=False)
        off_tree = _ended(tails, "ptr").select(F.col("root").alias("at"), "v", "depth").join(ring.select(F.col("v").alias("at"), F.col("root").alias("root_id")), "at").select(
            "v", F.when(F.col("depth") == 0, F.lit("cycle")).otherwise(F.lit("tail")).alias("link_kind"), "root_id", "depth", F.lit("").alias("full_path"), F.lit(-1).cast("long").alias("n_desc")
        )
    t = stages.save(_few(_with_heavy(tree.join(linked, "v"), tree, linked, intervals), n))
    chained = _chains(t, n, stages)
    placed = _placed(chained, n, stages, sep, paths)
    cols = ["v", "link_kind", "root_id", "depth", "full_path", "n_desc", *(["pre", "last"] if intervals else [])]
    out = placed.select(*cols)
    if off_tree is not None:
        for c in cols[6:]:
            off_tree = off_tree.withColumn(c, F.lit(None).cast("long"))
        out = out.unionByName(off_tree.select(*cols))
    result = stages.save(_few(out, n))
    stages.keep(result)
    return result.withColumnRenamed("v", node)


def _ended(tables: list[DataFrame], pointer: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.where(F.col(pointer).isNull()) for t in tables])


def _with_heavy(t: DataFrame, tree: DataFrame, linked: DataFrame, intervals: bool) -> DataFrame:
    """Adds to ``v, ptr, root, depth, size``: whether v is its parent's heavy child, and its offset in preorder below the parent."""
    # the heavy child: largest subtree, then smallest id; one pre-aggregated pass
    best = F.max(F.struct("size", (-F.col("v")).alias("v"))).alias("h")
    heavy = linked.where("ptr is not null").select("v", "ptr").join(tree.select("v", "size"), "v").groupBy("ptr").agg(best).select((-F.col("h.v")).alias("v"), F.lit(True).alias("heavy"))
    t = t.join(heavy, "v", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    if not intervals:
        return t.withColumn("off", F.lit(0).cast("long"))
    # within a parent the heavy child comes first, then the light ones in a fixed order
    light = prefix_sums(t.where("ptr is not null and not heavy").select("v", "ptr", "size"), ["ptr"], ["v"], "size", "earlier")
    first = t.where("heavy").select("ptr", F.col("size").alias("first"))
    offs = light.join(first, "ptr", "left").select("v", (F.col("earlier") + F.coalesce("first", F.lit(0)) + 1).alias("off"))
    return t.join(offs, "v", "left")


def _chains(t: DataFrame, n: int, stages: Stages) -> DataFrame:
    """Adds the head of each node's heavy chain, by doubling along heavy links only."""
    start = t.select("v", F.when(F.col("heavy"), F.col("ptr")).alias("up"), F.when(~F.col("heavy"), F.col("v")).alias("head"))
    tables = [stages.save(_few(start, n), left=F.count_if(F.col("up").isNotNull()))]
    while left := tables[-1].seen["left"]:
        # a heavy link has one child, so no key of `up` is hot before a head is known
        above = _few(_whole(tables, "up"), n).select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("head").alias("head2"))
        moved = _few(tables[-1].where("up is not null"), left).join(above, "up").select("v", F.col("up2").alias("up"), F.col("head2").alias("head"))
        tables.append(stages.save(_few(moved, left), left=F.count_if(F.col("up").isNotNull())))
    return t.join(_few(_ended(tables, "up"), n).select("v", "head"), "v")


def _placed(chained: DataFrame, n: int, stages: Stages, sep: str, paths: bool) -> DataFrame:
    """Forms the segments and prefixes of the heavy chains, and joins both."""
    seg = F.array_join(F.collect_list("nm").over(Window.partitionBy("head").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)), sep) if paths else F.lit(None).cast("string")
    t = stages.save(_few(chained.withColumn("seg", seg).select("v", "ptr", "root", "depth", "size", "head", "seg", "off"), n))

    # chain prefixes: at most log2(n) light links on a path, doubled over chains
    heads = t.where("v = head").select("head", "ptr", F.col("depth").alias("at"), "off")
    above = t.join(heads.where("ptr is not null").select(F.col("ptr").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("ptr"), F.col("head").alias("up"), F.col("seg").alias("pre_path"), F.col("depth").alias("pd"))
    tops = heads.select(F.col("head").alias("up"), F.col("at").alias("up_at"))
    c = skew_join(skew_join(heads, above, "ptr", "left"), tops, "up", "left")
    step = F.coalesce(F.col("pd") - F.col("up_at") + F.col("off"), F.lit(0))
    c = c.select("head", "at", "up", F.coalesce("pre_path", F.lit("")).alias("prefix"), step.alias("base"), F.col("up").isNotNull().alias("has"))
    tables = [stages.save(_few(c, n), left=F.count_if(F.col("up").isNotNull()))]
    while left := tables[-1].seen["left"]:
        over = _few(_whole(tables, "up"), n).select(F.col("head").alias("up"), F.col("up").alias("up2"), F.col("prefix").alias("prefix2"), F.col("base").alias("base2"), F.col("has").alias("has2"))
        path = F.when(F.col("has2"), F.concat_ws(sep, "prefix2", "prefix")).otherwise(F.col("prefix"))
        moved = skew_join(_few(tables[-1].where("up is not null"), left), over, "up", "inner").select("head", "at", F.col("up2").alias("up"), path.alias("prefix"), (F.col("base") + F.col("base2")).alias("base"), "has")
        tables.append(stages.save(_few(moved, left), left=F.count_if(F.col("up").isNotNull())))
    j = t.join(_few(_ended(tables, "up"), n).select("head", "prefix", "base", "has", "at"), "head")
    pre = F.col("base") + F.col("depth") - F.col("at")
    full = F.when(F.col("has"), F.concat(F.col("prefix"), F.lit(sep), F.col("seg"))).otherwise(F.col("seg")) if paths else F.lit(None).cast("string")
    return j.select("v", F.lit("tree").alias("link_kind"), F.col("root").alias("root_id"), "depth", full.alias("full_path"), (F.col("size") - 1).alias("n_desc"), pre.alias("pre"), (pre + F.col("size") - 1).alias("last"))
