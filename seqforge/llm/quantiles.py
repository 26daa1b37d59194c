"""Quantiles of groups that borrow from larger ones, from mergeable KLL sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sketch stands for the values at so many ranks, the middles of equal steps.
STEPS = 1000


def borrowed_weights(*sizes: Column, prior: float) -> list[Column]:
    """Weights of nested groups, the smallest first: each has n / (n + prior) of what the smaller ones leave, the last the
    rest. A null size is 0, so a group without rows takes the distribution of the next larger one."""
    left, out = F.lit(1.0), []
    for n in (F.coalesce(n, F.lit(0)).cast("double") for n in sizes[:-1]):
        out.append(left * n / (n + prior))
        left = left * prior / (n + prior)
    return [*out, left]


def mixture(parts: list[tuple[float, np.ndarray]], ranks: list[float]) -> list[float | None]:
    """The smallest values at which the weighted sum of distributions (weight, equally likely values) reaches each rank."""
    parts = [(w, v) for w, v in parts if v is not None and len(v)]
    if not parts:
        return [None] * len(ranks)
    values = np.concatenate([v for _, v in parts])
    share = np.concatenate([np.full(len(v), w / len(v)) for w, v in parts])
    by = np.argsort(values, kind="stable")
    upto = np.cumsum(share[by])
    at = np.searchsorted(upto, np.array(ranks) * upto[-1] - 1e-9)
    return values[by][np.minimum(at, len(values) - 1)].tolist()


def mixed_quantiles(sketches: list[Column], weights: list[Column], ranks: list[float]) -> Column:
    """Array of the quantiles of the sketches' weighted mixture; null sketches count as nothing."""
    middles = F.array(*[F.lit((k + 0.5) / STEPS) for k in range(STEPS)])

    @F.pandas_udf("array<double>")
    def mixed(values: pd.Series, shares: pd.Series) -> pd.Series:
        return pd.Series([mixture(list(zip(w, v)), ranks) for v, w in zip(values, shares)])

    return mixed(F.array(*[F.kll_sketch_get_quantile_double(s, middles) for s in sketches]), F.array(*weights))
