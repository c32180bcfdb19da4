"""Shrinkage covariances of whole trials and of equal windows.

The oracle-approximating shrinkage of Chen et al. (2010): with S the population
covariance of T centred samples in p channels and mu = tr(S) / p,
shrinkage = min(1, (a + mu^2) / ((T + 1) (a - mu^2 / p))) where a = mean(S_ij^2),
and the estimate (1 - shrinkage) S + shrinkage mu I.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covarium.functions.spd import spd_diagnostics, symmetrize


def oas(trial: np.ndarray) -> np.ndarray:
    """OAS covariance of channels x samples."""
    if trial.ndim != 2 or trial.shape[1] < 2 or not np.isfinite(trial).all():
        raise ValueError("a trial is a finite channels x samples matrix with two samples or more")
    x = trial.astype(float) - trial.mean(axis=1, keepdims=True)
    p, t = x.shape
    s = x @ x.T / t
    mu, a = np.trace(s) / p, np.mean(s * s)
    gap = (t + 1) * (a - mu * mu / p)
    shrink = 1.0 if gap == 0 else min((a + mu * mu) / gap, 1.0)
    return symmetrize((1 - shrink) * s + shrink * mu * np.eye(p))


def window_slices(n_samples: int, n_windows: int = 5) -> list[slice]:
    """Equal, ordered windows; an error where they don't divide the trial or hold fewer than two samples."""
    size, rest = divmod(n_samples, n_windows)
    if rest or size < 2:
        raise ValueError(f"{n_samples} samples don't make {n_windows} equal windows of two or more")
    return [slice(i * size, (i + 1) * size) for i in range(n_windows)]


def of_epochs(epochs: DataFrame, key: list[str], n_windows: int = 5, signal: str = "signal") -> DataFrame:
    """Covariances of array-format trials: a WHOLE row and ``n_windows`` WINDOW rows each, in Arrow batches.

    ``signal`` is array<array<float>>, channels x samples.  Returns key, representation,
    window_index (null for WHOLE), n, cov.
    """
    schema = ", ".join(f"{k} {epochs.schema[k].dataType.simpleString()}" for k in key) + ", representation string, window_index bigint, n int, cov array<double>"

    def run(batches):
        for b in batches:
            rows = []
            for keys, value in zip(b[key].itertuples(index=False, name=None), b[signal]):
                x = np.stack([np.asarray(c, float) for c in value])
                rows.append((*keys, "WHOLE", None, len(x), oas(x).ravel()))
                rows += [(*keys, f"WINDOW{n_windows}", i + 1, len(x), oas(x[:, s]).ravel()) for i, s in enumerate(window_slices(x.shape[1], n_windows))]
            yield pd.DataFrame(rows, columns=[*key, "representation", "window_index", "n", "cov"]).astype({"window_index": "Int64"})

    return epochs.select(*key, signal).mapInPandas(run, schema)


def of_samples(samples: DataFrame, by: list[str], channels: list[Column]) -> DataFrame:
    """Covariances of long-format trials, a row per sample, by aggregates only: by, n, fit_n, shrinkage, cov.

    Moments are partially aggregated, so a long trial costs each task one row.
    """
    p = len(channels)
    rows = samples.select(*by, *[c.cast("double").alias(f"c_{i}") for i, c in enumerate(channels)])
    moments = [F.covar_pop(f"c_{i}", f"c_{j}").alias(f"s_{i}_{j}") for i in range(p) for j in range(i, p)]
    m = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("fit_n"), *moments)
    s = lambda i, j: F.col(f"s_{min(i, j)}_{max(i, j)}")
    mu = sum((s(i, i) for i in range(1, p)), s(0, 0)) / p
    square = sum((s(i, j) * s(i, j) * (1 if i == j else 2) for i in range(p) for j in range(i, p)), F.lit(0.0)) / (p * p)
    m = m.withColumn("mu", mu).withColumn("a", square)
    gap = (F.col("fit_n") + 1) * (F.col("a") - F.col("mu") * F.col("mu") / p)
    m = m.withColumn("shrinkage", F.when(gap == 0, 1.0).otherwise(F.least(F.try_divide(F.col("a") + F.col("mu") * F.col("mu"), gap), F.lit(1.0))))
    w = F.col("shrinkage")
    cov = [(1 - w) * s(i, j) + (w * F.col("mu") if i == j else F.lit(0.0)) for i in range(p) for j in range(p)]
    return m.select(*by, F.lit(p).alias("n"), "fit_n", "shrinkage", F.array(*cov).alias("cov"))


def assign_windows(samples: DataFrame, by: list[str], order: list, n_windows: int, n_samples: int) -> DataFrame:
    """The first n_samples of each trial with window_index 1..n; an error where they don't divide evenly."""
    from pyspark.sql import Window as W

    size = len(range(*window_slices(n_samples, n_windows)[0].indices(n_samples)))
    rn = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return samples.withColumn("sample", rn).where(F.col("sample") < n_samples).withColumn("window_index", (F.floor(F.col("sample") / size) + 1).cast("long"))


def sanity(covs: DataFrame, cov: str = "cov") -> DataFrame:
    """Adds a struct ``check`` with finite, symmetry_error, eigenvalues, condition_number and is_spd; no row is dropped."""
    return covs.withColumn("check", spd_diagnostics(cov))


def sanity_summary(checked: DataFrame, by: list[str]) -> DataFrame:
    """Counts and extremes of ``sanity`` by group."""
    c = lambda name: F.col(f"check.{name}")
    n = lambda x: F.sum(x.cast("long")).cast("long")
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n(c("is_spd")).alias("n_spd"), n(~c("is_spd")).alias("n_non_spd"), n(~c("finite")).alias("n_non_finite"),
        F.min(c("min_eigenvalue")).alias("min_eigenvalue"), F.max(c("max_eigenvalue")).alias("max_eigenvalue"), F.max(c("condition_number")).alias("max_condition"), F.max(c("symmetry_error")).alias("max_symmetry_error"),
    )
