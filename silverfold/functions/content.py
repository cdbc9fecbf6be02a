"""Fingerprints of contents: quick, picture-only and perceptual hashes, signatures, histograms, cache keys."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes read at each end, signature layout and thresholds.
PROBE = 64 * 1024
SIGNATURE_VERSION, LUMA, CHROMA = 1, 256, 128
LUMA_LIMIT, CHROMA_LIMIT = 3.5, 8.0


def quick_hash(data: bytes) -> str:
    """xxHash64 of the first 64 KiB, and the last if there are more than two, seeded by the length."""
    h = xxhash.xxh64(data[:PROBE], seed=len(data))
    if len(data) > 2 * PROBE:
        h.update(data[-PROBE:])
    return h.hexdigest()


def picture_hash(d: bytes) -> str | None:
    """SHA-256 of what of a JPEG is picture: its segments without application data and comments.

    Copies that differ in their metadata alone have the same. None for other and broken files.
    """
    if d[:2] != b"\xff\xd8" or len(d) < 4:
        return None
    h, at = hashlib.sha256(b"\xff\xd8"), 2
    while True:
        while at < len(d) and d[at] == 0xFF:
            at += 1
        if at >= len(d) or d[at] == 0:
            return None
        marker, at = d[at], at + 1
        head = bytes((0xFF, marker))
        if marker == 0xD9:
            h.update(head)
            return h.hexdigest()
        if marker == 0xDA:
            end = d.find(b"\xff\xd9", at)
            h.update(d[at - 2 : len(d) if end < 0 else end + 2])
            return h.hexdigest()
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            h.update(head)
            continue
        size = int.from_bytes(d[at : at + 2], "big")
        if at + 2 > len(d) or size < 2 or at + size > len(d):
            return None
        if marker != 0xFE and not 0xE0 <= marker <= 0xEF:
            h.update(head + d[at : at + size])
        at += size


_K = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] / 64)


def perceptual_hash(gray: np.ndarray) -> int:
    """64 bits of a 32 x 32 gray picture: which of its 8 x 8 lowest DCT terms lie above their median."""
    low = (_K @ gray.astype(float) @ _K.T).ravel()
    bits = low > np.median(low)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def average_hash(gray: np.ndarray) -> int:
    """64 bits of an 8 x 8 gray picture: which pixels lie above the mean."""
    g = gray.astype(float)
    return int.from_bytes(np.packbits((g > g.mean()).ravel()).tobytes(), "big")


def signature(gray: np.ndarray, rgb8: np.ndarray) -> bytes:
    """385 bytes: a version, 16 x 16 mean brightness, 8 x 8 blue and red differences."""
    luma = (gray.astype(int).reshape(16, 2, 16, 2).sum(axis=(1, 3)) // 4).astype(np.uint8)
    r, g, b = (rgb8[..., i].astype(float) for i in range(3))
    cb = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b
    cr = 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    chroma = np.clip(np.floor(np.stack([cb, cr], axis=-1) + 0.5), 0, 255).astype(np.uint8)
    return bytes([SIGNATURE_VERSION]) + luma.tobytes() + chroma.tobytes()


def alike(a: bytes | None, b: bytes | None) -> bool:
    """Whether two signatures show one picture: brightness and colour differ little on average."""
    if not a or not b or len(a) != 1 + LUMA + CHROMA or len(b) != len(a) or a[0] != SIGNATURE_VERSION or b[0] != SIGNATURE_VERSION:
        return False
    d = np.abs(np.frombuffer(a, np.uint8)[1:].astype(int) - np.frombuffer(b, np.uint8)[1:].astype(int))
    return bool(d[:LUMA].mean() <= LUMA_LIMIT and d[LUMA:].mean() <= CHROMA_LIMIT)


def signature_rows(signatures: pd.Series) -> np.ndarray:
    """Signatures as rows of numbers; those of another length or version are rows of -1."""
    out = np.full((len(signatures), LUMA + CHROMA), -1, np.int16)
    for i, s in enumerate(signatures):
        if s is not None and len(s) == 1 + LUMA + CHROMA and s[0] == SIGNATURE_VERSION:
            out[i] = np.frombuffer(s, np.uint8)[1:]
    return out


def alike_rows(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which rows of numbers are alike to ``row``, as :func:`alike` has it."""
    d = np.abs(rows - row)
    ok = (rows[:, 0] >= 0) & (row[0] >= 0)
    return ok & (d[:, :LUMA].mean(axis=1) <= LUMA_LIMIT) & (d[:, LUMA:].mean(axis=1) <= CHROMA_LIMIT)


@F.pandas_udf(T.BooleanType())
def alike_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`alike` of two signature columns; false where either is missing."""
    x, y = signature_rows(a), signature_rows(b)
    d = np.abs(x - y)
    ok = (x[:, 0] >= 0) & (y[:, 0] >= 0)
    return pd.Series(ok & (d[:, :LUMA].mean(axis=1) <= LUMA_LIMIT) & (d[:, LUMA:].mean(axis=1) <= CHROMA_LIMIT))


#: FNV-1a of 64 bits (fixed values).
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def cache_keys(paths: list[bytes], size: np.ndarray, modified: np.ndarray) -> np.ndarray:
    """FNV-1a, 64 bits, over each path and, as 8 little-endian bytes each, its size and time: all rows a byte at a time."""
    length = np.array([len(p) for p in paths], np.int64)
    tail = np.stack([size.astype("<i8"), modified.astype("<i8")], axis=1).view(np.uint8).reshape(len(paths), 16)
    order = np.argsort(-length, kind="stable")  # longest first, so those with a byte left are the first rows
    joined = np.frombuffer(b"".join(paths), np.uint8)
    first = (np.cumsum(length) - length)[order]
    h, left = np.full(len(paths), FNV_START, np.uint64), length[order]
    with np.errstate(over="ignore"):
        for at in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -at, side="left"))
            h[:n] = (h[:n] ^ joined[first[:n] + at]) * np.uint64(FNV_PRIME)
        for at in range(16):
            h = (h ^ tail[order, at]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def cache_key(path: str, size: int, modified: int) -> str:
    """FNV-1a, 64 bits, over path, size and time, in hexadecimal."""
    return f"{int(cache_keys([path.encode()], np.array([size]), np.array([modified]))[0]):016x}"


def histogram(rgb: np.ndarray) -> dict:
    """256 counts a channel, their peak without the ends, and the shares of clipped shadows and lights."""
    counts = np.stack([np.bincount(rgb[..., i].ravel(), minlength=256) for i in range(3)])
    bright = rgb.reshape(-1, 3)
    n = max(len(bright), 1)
    return {"counts": counts, "peak": int(counts[:, 1:255].max(initial=1)), "shadows": float((bright <= 2).all(axis=1).sum() / n), "lights": float((bright >= 253).all(axis=1).sum() / n)}


@F.pandas_udf(T.StructType([T.StructField("peak", T.LongType()), T.StructField("shadows", T.DoubleType()), T.StructField("lights", T.DoubleType()), T.StructField("counts", T.ArrayType(T.ArrayType(T.LongType())))]))
def histogram_of(rgb: pd.Series) -> pd.DataFrame:
    """:func:`histogram` of a column of pictures, three bytes a pixel; null for another length."""
    rows = [histogram(np.frombuffer(b, np.uint8).reshape(-1, 3)) if b is not None and len(b) and len(b) % 3 == 0 else None for b in rgb]
    col = lambda k: [r[k] if r else None for r in rows]
    return pd.DataFrame({"peak": pd.array(col("peak"), "Int64"), "shadows": col("shadows"), "lights": col("lights"), "counts": [r["counts"].tolist() if r else None for r in rows]})


@F.pandas_udf(T.BinaryType())
def signature_of(gray: pd.Series, rgb: pd.Series) -> pd.Series:
    """:func:`signature` of 32 x 32 gray and 8 x 8 colour bytes; null for other lengths."""
    ok = lambda g, c: g is not None and c is not None and len(g) == 1024 and len(c) == 192
    return pd.Series([signature(np.frombuffer(g, np.uint8).reshape(32, 32), np.frombuffer(c, np.uint8).reshape(8, 8, 3)) if ok(g, c) else None for g, c in zip(gray, rgb, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def quick_hash_of(content: pd.Series) -> pd.Series:
    return content.map(quick_hash, na_action="ignore")


@F.pandas_udf(T.StringType())
def picture_hash_of(content: pd.Series) -> pd.Series:
    return content.map(lambda d: picture_hash(bytes(d)), na_action="ignore")


@F.pandas_udf(T.LongType())
def perceptual_hash_of(gray: pd.Series) -> pd.Series:
    """Of 1,024 gray bytes in row order; as a signed long, null for other lengths."""
    return gray.map(lambda g: int(np.array(perceptual_hash(np.frombuffer(g, np.uint8).reshape(32, 32)), np.uint64).view(np.int64)) if g is not None and len(g) == 1024 else None).astype("Int64")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_of(blob: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats of a binary column."""
    return blob.map(lambda b: np.frombuffer(b, "<f4"), na_action="ignore")


@F.pandas_udf(T.StringType())
def cache_key_of(path: pd.Series, size: pd.Series, modified: pd.Series) -> pd.Series:
    """:func:`cache_key` of columns; null where any of the three is."""
    ok = (path.notna() & size.notna() & modified.notna()).to_numpy()
    out = np.full(len(path), None, object)
    keys = cache_keys([p.encode() for p in path[ok]], size[ok].to_numpy(np.int64), modified[ok].to_numpy(np.int64))
    out[ok] = [f"{k:016x}" for k in keys.tolist()]
    return pd.Series(out, dtype=object)
