"""Helpers that keep a hot key from ending up in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key counts as hot when it holds more than this share of the left rows, so there
#: are at most ``1 / HOT_SHARE`` hot keys, which bounds what is broadcast.
HOT_SHARE = 0.002


def hot_keys(left: DataFrame, key: str, share: float = HOT_SHARE, least: int = 20_000) -> list:
    """Keys of ``left`` holding more than ``share`` of its rows (at most ``1/share``)."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    # candidates are cut before the total is needed: no key under `least` can be hot
    big = counts.where(F.col("__n") > least)
    n = left.count() if big.limit(1).count() else 0
    return [r[0] for r in big.where(F.col("__n") > max(least, share * n)).select(key).collect()] if n else []


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join ``left`` with ``right`` (unique on ``key``) without a hot task.

    Rows of hot keys meet the few right rows of those keys by a broadcast of at most
    ``1/HOT_SHARE`` rows; all others take the shuffled join. ``how``: left or inner.
    Null keys never match; a left join keeps their rows.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(hot)))
    return left.where(~is_hot).join(right.where(~is_hot), key, how).unionByName(left.where(is_hot).join(few, key, how))


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str | Column, out: str, buckets: int = 256) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group, ``out``, without the row itself.

    The order is (hash bucket of ``order``, ``order``): any fixed order will do for the
    callers. Group keys must not be null. Groups are cut into ``buckets`` parts, so a group holding a third of all
    rows is never sorted in one task: bucket totals are pre-aggregated and summed up first.
    """
    value = F.col(value) if isinstance(value, str) else value
    df = df.withColumn("__v", value).withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    parts = df.groupBy(*group, "__b").agg(F.sum("__v").alias("__s"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy(*group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("__in", F.coalesce(F.sum("__v").over(w), F.lit(0)))
    return inner.join(parts, [*group, "__b"]).withColumn(out, F.col("__before") + F.col("__in")).drop("__v", "__b", "__before", "__in")
