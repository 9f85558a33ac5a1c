"""Vector maths used inside Arrow batches (numpy), and the matching Column forms.

Scores are cosine similarities computed in float64 and rounded to
``ROUND_DIGITS`` decimals *before* ranking or thresholding, so that the last
bits of a different summation order (another engine, another BLAS) cannot
reorder ties. A zero vector scores 0 against everything (cosine with an
epsilon-guarded normalisation).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_DIGITS = 6


def stack(values) -> np.ndarray:
    """Stack a pandas/Arrow column of equal-length arrays into an (n, d) float64 matrix."""
    if len(values) == 0:
        return np.zeros((0, 0), dtype=np.float64)
    return np.vstack([np.asarray(v, dtype=np.float64) for v in values])


def l2_normalise(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1)
    safe = np.where(norms > 0, norms, 1.0)
    out = m / safe[:, None]
    out[norms == 0] = 0.0
    return out


def round_scores(s: np.ndarray, digits: int = ROUND_DIGITS) -> np.ndarray:
    # + 0.0 turns a rounded -0.0 into 0.0
    return np.round(s, digits) + 0.0


def dot(a: Column, b: Column) -> Column:
    """Dot product of two array columns, in double (JVM side, no Python)."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column, digits: int = ROUND_DIGITS) -> Column:
    """Cosine of two array columns, rounded; 0 when either vector is zero."""
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0)), digits) + F.lit(0.0)
