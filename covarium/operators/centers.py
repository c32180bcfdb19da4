"""Label-free domain centers in four geometries, and the transforms they define.

RAW has no center.  LE (log-Euclidean) subtracts the mean logarithm, AIRM (affine-
invariant) and EA (arithmetic) whiten by the inverse root of the mean.  LE and EA
centers are averages of arrays, so they are partially aggregated at any group size;
the AIRM mean gathers a group where it has at most ``grouped_rows`` matrices and is
otherwise iterated over the cluster, one averaged tangent per step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.functions import spd
from covarium.functions.vectors import group_mean_vector, norm, sub
from covarium.operators.trials import assert_label_free
from covarium.sources.sinks import scratch

GEOMETRIES = ("RAW", "LE", "AIRM", "EA")
GROUPED_ROWS = 100_000


def with_log(covs: DataFrame) -> DataFrame:
    """Adds coords, the packed logarithm of ``cov``."""
    return covs.withColumn("coords", spd.log_svec("cov"))


def log_euclidean_centers(coords: DataFrame, by: list[str]) -> DataFrame:
    """by, fit_n, log_mean (packed)."""
    return group_mean_vector(coords, by, "coords", "log_mean")


def center_coordinates(coords: DataFrame, by: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Adds ``centered``: coordinates less their group's mean over ``fit`` (by default, all rows).

    There are as many centers as groups; Spark broadcasts them where they are small.
    """
    centers = log_euclidean_centers(coords if fit is None else fit, by)
    return coords.join(centers, by).withColumn("centered", sub(F.col("coords"), F.col("log_mean")))


def residual(centered: DataFrame, by: list[str], column: str = "centered") -> DataFrame:
    """Largest absolute entry of any group's mean."""
    long = centered.select(*by, F.posexplode(column).alias("pos", "v"))
    return long.groupBy(*by, "pos").agg(F.avg("v").alias("m")).agg(F.max(F.abs("m")).alias("max_abs"))


def arithmetic_centers(covs: DataFrame, by: list[str]) -> DataFrame:
    return group_mean_vector(covs, by, "cov", "mean")


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def karcher_centers(covs: DataFrame, by: list[str], tol: float = 1e-9, max_iter: int = 100, grouped_rows: int = GROUPED_ROWS) -> DataFrame:
    """by, fit_n, mean, karcher_residual, iterations, warnings."""
    sizes = covs.groupBy(*by).count()
    most = sizes.agg(F.max("count")).first()[0] or 0
    if most > grouped_rows:
        return _karcher_iterated(covs, by, tol, max_iter)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mean, left, steps, warned = spd.karcher(spd.stack(rows["cov"]), tol, max_iter)
        keys = {b: [rows[b].iloc[0]] for b in by}
        return pd.DataFrame(keys | {"fit_n": [len(rows)], "mean": [mean.ravel()], "karcher_residual": [left], "iterations": [steps], "warnings": [warned]})

    return covs.select(*by, "cov").groupBy(*by).applyInPandas(run, f"{_schema(covs, by)}, fit_n bigint, mean array<double>, karcher_residual double, iterations int, warnings array<string>")


_TANGENT = F.pandas_udf(lambda w, c: spd._rows(spd.pack(spd.log(spd.symmetrize(spd.stack(w) @ spd.stack(c) @ spd.stack(w))))), spd.MATRIX)


def _step(size: float):
    def run(mean: pd.Series, tangent: pd.Series) -> pd.Series:
        m, t = spd.stack(mean), spd.unpack(np.stack([np.asarray(v) for v in tangent]))
        root = spd.sqrt(m)
        return spd._rows(spd.symmetrize(root @ spd.exp(size * t) @ root))

    return F.pandas_udf(run, spd.MATRIX)


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def _karcher_iterated(covs: DataFrame, by: list[str], tol: float, max_iter: int) -> DataFrame:
    """Steps over the cluster: each averages tangents at the current means; means are checkpointed."""
    now, done, last = _checkpointed(arithmetic_centers(covs, by).select(*by, "fit_n", "mean")), 0, 1.0
    for done in range(1, max_iter + 1):
        at = covs.join(now.withColumn("w", spd.spd_invsqrt("mean")), by).withColumn("t", _TANGENT("w", "cov"))
        tangents = group_mean_vector(at, by, "t", "tangent", "t_n").withColumn("size", norm(F.col("tangent")))
        met = _checkpointed(now.join(tangents, by))
        worst = met.agg(F.max("size")).first()[0]
        if worst <= tol:
            break
        last *= 0.95
        now = _checkpointed(met.select(*by, "fit_n", _step(last)("mean", "tangent").alias("mean")))
    return met.select(*by, "fit_n", "mean", (F.col("size") / F.sqrt(F.sqrt(F.size("mean")))).alias("karcher_residual"), F.lit(done).alias("iterations"), F.when(F.col("size") > tol * 10, F.array(F.lit("no convergence"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def fit_centers(view: DataFrame, geometry: str, by: list[str]) -> DataFrame:
    """Centers of one geometry: by, geometry, fit_n, mean, log_mean, congruence, karcher_residual, warnings.

    ``view`` has ``by`` and ``cov``; label columns are rejected.  RAW isn't fitted: fit_n is 0.
    """
    if geometry not in GEOMETRIES:
        raise ValueError(f"unknown geometry {geometry!r}")
    assert_label_free(view)
    if geometry == "RAW":
        out = view.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("fit_n"))
    elif geometry == "LE":
        out = log_euclidean_centers(with_log(view), by)
        out = out.withColumn("mean", spd.symmetric_exp(_UNPACK("log_mean")))
    elif geometry == "EA":
        out = arithmetic_centers(view, by).withColumn("congruence", spd.spd_invsqrt("mean"))
    else:
        out = karcher_centers(view, by).withColumn("congruence", spd.spd_invsqrt("mean"))
    for c, kind in (("mean", "array<double>"), ("log_mean", "array<double>"), ("congruence", "array<double>"), ("karcher_residual", "double"), ("warnings", "array<string>")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out.select(*by, F.lit(geometry).alias("geometry"), "fit_n", "mean", "log_mean", "congruence", "karcher_residual", "warnings")


_UNPACK = F.pandas_udf(lambda v: spd._rows(spd.unpack(np.stack([np.asarray(x) for x in v]))) if len(v) else v, spd.MATRIX)
_LE_COV = F.pandas_udf(lambda v: spd._rows(spd.exp(spd.unpack(np.stack([np.asarray(x) for x in v])))) if len(v) else v, spd.MATRIX)


def transform(covs: DataFrame, centers: DataFrame, geometry: str, by: list[str]) -> DataFrame:
    """``covs`` with ``cov`` moved to its group's center; rows of groups without a center are an error upstream, not dropped here."""
    if geometry == "RAW":
        return covs
    met = covs.join(centers.select(*by, F.col("log_mean").alias("t_log"), F.col("congruence").alias("t_w")), by, "left")
    moved = _LE_COV(sub(spd.log_svec("cov"), F.col("t_log"))) if geometry == "LE" else spd.congruence("t_w", "cov")
    return met.withColumn("cov", moved).drop("t_log", "t_w")


def crosscheck(covs: DataFrame, by: list[str]) -> DataFrame:
    """AIRM means against an independent solver (plain fixed-point steps): by, distance; the third-party check itself is unavailable here."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m = spd.stack(rows["cov"])
        mean = spd.karcher(m)[0]
        other = spd.exp(spd.log(m).mean(axis=0)[None])[0]
        for _ in range(200):
            w, r = spd.invsqrt(other[None])[0], spd.sqrt(other[None])[0]
            t = spd.log(spd.symmetrize(w @ m @ w)).mean(axis=0)
            other = spd.symmetrize(r @ spd.exp((0.5 * t)[None])[0] @ r)
            if np.linalg.norm(t) < 1e-11:
                break
        keys = {b: [rows[b].iloc[0]] for b in by}
        return pd.DataFrame(keys | {"distance": [float(spd.airm(mean[None], other[None])[0])], "status": ["SKIPPED_API_UNAVAILABLE"]})

    return covs.select(*by, "cov").groupBy(*by).applyInPandas(run, f"{_schema(covs, by)}, distance double, status string")
