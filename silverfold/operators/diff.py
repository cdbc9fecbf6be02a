"""Differences between two copies of a table (problem 6), by content-defined chunking."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverfold.session import Stages

#: Rows over whose keys the rolling hash runs, and rows per chunk on average.
WINDOW, CHUNK_ROWS = 4, 16


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(col: Column) -> Column:
    """Unicode NFC of a text; plain ASCII never leaves the JVM as more than a null."""
    odd = col.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfc(F.when(odd, col)), col)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _chunks(key: np.ndarray, fp: np.ndarray, chunk_rows: int):
    """First row of each chunk of one side, and the chunks' fingerprints.

    A row starts a chunk where the hash rolling over the keys of the last WINDOW rows
    falls into one of ``chunk_rows`` classes; the block's first row always does.
    """
    n = len(key)
    roll = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        roll[i:] += key[: n - i] * np.uint64(2 * i + 1)
    cut = _mix(roll) % np.uint64(chunk_rows) == 0
    cut[0] = True
    at = np.flatnonzero(cut)
    sums = np.add.reduceat(fp, at)
    xors = np.bitwise_xor.reduceat(_mix(fp), at)
    size = np.diff(np.append(at, n))
    return at, size, list(zip(key[at].tolist(), size.tolist(), sums.tolist(), xors.tolist(), strict=True))


def _unmatched(key: np.ndarray, fp: np.ndarray, side: np.ndarray, chunk_rows: int) -> np.ndarray:
    """Keys of the chunks whose fingerprint the other side doesn't have."""
    rows = [np.flatnonzero(side == s) for s in (0, 1)]
    with np.errstate(over="ignore"):
        cut = [_chunks(key[r], fp[r], chunk_rows) if len(r) else (None, None, []) for r in rows]
    keep = []
    for mine, other in ((0, 1), (1, 0)):
        have = set(cut[other][2])
        if len(rows[mine]):
            keep.append(key[rows[mine][np.repeat([c not in have for c in cut[mine][2]], cut[mine][1])]])
    return np.concatenate(keep) if keep else key[:0]


def _once(key: np.ndarray, fp: np.ndarray, side: np.ndarray):
    """Drops repeated rows: same key, side and fingerprint, next to each other."""
    again = np.append(False, (key[1:] == key[:-1]) & (side[1:] == side[:-1]) & (fp[1:] == fp[:-1]))
    return key[~again], fp[~again], side[~again]


def _chunk_filter(chunk_rows: int):
    def out(parts) -> pa.RecordBatch:
        keys = _unmatched(*_once(*(np.concatenate(c) for c in zip(*parts, strict=True))), chunk_rows)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["__k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, f, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            k, f = k.view(np.uint64), f.view(np.uint64)
            # the last key may go on in the next batch; a block always ends between keys, at the same key for both
            # sides. A key that goes on through whole batches is held in parts, each without its repeats
            other = np.flatnonzero(k != k[-1])
            end = int(other[-1]) + 1 if len(other) else (0 if not held or held[-1][0][-1] == k[-1] else -1)
            if end == -1:
                yield out(held)
                held, end = [], 0
            elif end:
                yield out([*held, (k[:end], f[:end], s[:end])])
                held = []
            held.append(_once(k[end:], f[end:], s[end:]))
        if held:
            yield out(held)

    return run


#: Bits of the filter that tells the keys of unmatched chunks; at most 2^18 words of it are broadcast.
FILTER_BITS = 24


def diff_copies(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What differs between two copies: ``keys..., field``.

    field is ``only_a`` or ``only_b`` for a key on one side only, else the name of each
    of ``fields`` whose values differ, null being equal to null only.

    First only keys and a hash of each row move: both copies are put into key order by one range exchange (a hot leading key is
    spread like any other, as all keys take part in the range). There each side is cut into
    chunks where the hash rolling over its keys says so, and chunks whose fingerprint
    (first key, rows, sum and xor of row hashes) the other side has as well are dropped:
    the anti-join needs no exchange, since both sides have the same key ranges. The keys of the
    other chunks become a filter of fixed size, by which the rows to compare are read from both copies; its
    few false hits are rows that do not differ. Only those rows move, to be matched by key and compared field by field.

    Null keys match null keys. Repeated rows count once. Where one side has several
    different rows of one key, the smallest of each field stands for them, null last. Empty copies
    give no rows, or all of the other side. Columns besides keys and fields are ignored.
    """
    ks = [f"__key{i}" for i in range(len(keys))]
    fs = [f"__field{i}" for i in range(len(fields))]

    def one(df: DataFrame, side: int) -> DataFrame:
        return df.select(F.lit(side).cast("int").alias("__side"), *(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), *(F.col(f).alias(n) for f, n in zip(fields, fs, strict=True)))

    rows = one(a, 0).unionByName(one(b, 1))
    nulls = [F.col(c).isNull() for c in (*ks, *fs)]
    rows = rows.withColumn("__k", F.xxhash64(*ks, *nulls[: len(ks)]))
    stages = Stages(a.sparkSession, "diff")
    # written once, so that the ranges are sampled from this and not from the copies
    slim = stages.save(rows.select("__k", F.xxhash64(*ks, *fs, *nulls).alias("__f"), "__side", *ks))
    ordered = slim.repartitionByRange(*ks).sortWithinPartitions(*ks, "__side", "__f").select("__k", "__f", "__side")
    odd = ordered.mapInArrow(_chunk_filter(chunk_rows), "__k long")
    at = F.col("__k").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(__k & 63 as int))")
    words = odd.groupBy(F.shiftright(at, 6).alias("__w")).agg(F.bit_or(bit).alias("__bits"))
    met = rows.withColumn("__w", F.shiftright(at, 6)).join(F.broadcast(words), "__w").where(F.col("__bits").bitwiseAND(bit) != 0)
    on = [F.col("__side") == s for s in (0, 1)]
    met = met.groupBy(*ks).agg(
        *(F.max(x).alias(f"__on{s}") for s, x in enumerate(on)),
        *(F.min(F.when(on[s], F.struct(F.col(f).isNull().alias("n"), F.col(f).alias("v")))).alias(f"{f}_{s}") for f in fs for s in (0, 1)),
    )
    differs = [F.when(~F.col(f"{f}_0.v").eqNullSafe(F.col(f"{f}_1.v")), F.lit(n)) for f, n in zip(fs, fields, strict=True)]
    field = F.when(~F.col("__on1"), F.array(F.lit("only_a"))).when(~F.col("__on0"), F.array(F.lit("only_b"))).otherwise(F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>"))
    return met.select(*(F.col(n).alias(k) for k, n in zip(keys, ks, strict=True)), F.explode(field).alias("field"))
