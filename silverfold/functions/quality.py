"""Scores of pictures: sharpness, exposure, and both with the rest in one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the whole score (fixed values): sharpness, exposure, size, judgement.
WEIGHTS = {"sharpness": 0.45, "exposure": 0.30, "size": 0.15, "judgement": 0.10}


def sharpness(gray: np.ndarray) -> float:
    """Variance of the Laplacian inside a gray picture; 0 for one too small to have one."""
    g = gray.astype(float)
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def exposure(gray: np.ndarray) -> float:
    """1 for a mean of middle gray, falling to 0 at black and white."""
    return float(1 - abs(gray.astype(float).mean() - 127.5) / 127.5) if gray.size else 0.0


def score(sharp: Column, exposed: Column, size: Column, judged: Column) -> Column:
    """The weighted score of parts between 0 and 1; missing parts count as 0."""
    part = lambda c: F.coalesce(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    w = list(WEIGHTS.values())
    return part(sharp) * w[0] + part(exposed) * w[1] + part(size) * w[2] + part(judged) * w[3]
