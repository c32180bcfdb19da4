"""Functions of symmetric positive-definite matrices, as Arrow-batched column functions.

Matrices are row-major ``array<double>``.  All rows of an Arrow batch with one size
are stacked and go through one eigendecomposition call.  Eigenvalues are never
clipped: a non-positive one where a logarithm or root is asked for raises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covarium.functions.vectors import matrix_side


#: Types are objects, for workers import this module without a session that could parse names.
MATRIX = T.ArrayType(T.DoubleType())
_DIAGNOSTICS = T.StructType([T.StructField("finite", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in ("symmetry_error", "min_eigenvalue", "max_eigenvalue", "condition_number", "evd_error")], T.StructField("is_spd", T.BooleanType())])


def stack(values: pd.Series) -> np.ndarray:
    flat = np.stack([np.asarray(v, float) for v in values])
    n = int(round(flat.shape[1] ** 0.5))
    if n * n != flat.shape[1]:
        raise ValueError(f"{flat.shape[1]} entries are no square matrix")
    return flat.reshape(-1, n, n)


def symmetrize(m: np.ndarray) -> np.ndarray:
    return (m + np.swapaxes(m, -1, -2)) / 2


def relative_asymmetry(m: np.ndarray) -> np.ndarray:
    """Frobenius norm of the antisymmetric difference over the matrix's own."""
    size = np.linalg.norm(m, axis=(-2, -1))
    return np.linalg.norm(m - np.swapaxes(m, -1, -2), axis=(-2, -1)) / np.maximum(size, np.finfo(float).tiny)


def spectral(m: np.ndarray, f, positive: bool = True) -> np.ndarray:
    """f applied to eigenvalues, symmetrised."""
    if not np.isfinite(m).all():
        raise ValueError("a matrix has entries that are not finite")
    if (relative_asymmetry(m) > 1e-10).any():
        raise ValueError("a matrix is not symmetric")
    w, v = np.linalg.eigh(symmetrize(m))
    if positive and (w <= 0).any():
        raise ValueError("a matrix is not positive definite")
    return symmetrize((v * f(w)[..., None, :]) @ np.swapaxes(v, -1, -2))


def log(m):
    return spectral(m, np.log)


def exp(m):
    out = spectral(m, np.exp, positive=False)
    if not np.isfinite(out).all() or (np.linalg.eigvalsh(out) <= 0).any():
        raise FloatingPointError("the exponential over- or underflows")
    return out


def invsqrt(m):
    return spectral(m, lambda w: w**-0.5)


def sqrt(m):
    return spectral(m, np.sqrt)


def pack(m: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(m.shape[-1])
    return m[..., i, j] * np.where(i == j, 1.0, np.sqrt(2))


def unpack(v: np.ndarray) -> np.ndarray:
    n = matrix_side(v.shape[-1])
    i, j = np.triu_indices(n)
    out = np.zeros((*v.shape[:-1], n, n))
    out[..., i, j] = out[..., j, i] = v / np.where(i == j, 1.0, np.sqrt(2))
    return out


def airm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = invsqrt(a)
    w = np.linalg.eigvalsh(symmetrize(root @ b @ root))
    if (w <= 0).any():
        raise ValueError("a matrix is not positive definite")
    return np.sqrt((np.log(w) ** 2).sum(axis=-1))


def _rows(m: np.ndarray) -> pd.Series:
    return pd.Series(list(m.reshape(len(m), -1)))


def _unary(f):
    def run(c: pd.Series) -> pd.Series:
        return _rows(f(stack(c))) if len(c) else c

    return F.pandas_udf(run, MATRIX)


spd_log = _unary(log)
symmetric_exp = _unary(exp)
spd_invsqrt = _unary(invsqrt)
log_svec = _unary(lambda m: pack(log(m)))


@F.pandas_udf(T.DoubleType())
def airm_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(airm(stack(a), stack(b))) if len(a) else pd.Series([], dtype=float)


@F.pandas_udf(MATRIX)
def congruence(w: pd.Series, c: pd.Series) -> pd.Series:
    """W C W, symmetrised; the result has to be positive definite."""
    if not len(c):
        return c
    a, b = stack(w), stack(c)
    out = symmetrize(a @ b @ a)
    if (np.linalg.eigvalsh(out) <= 0).any():
        raise ValueError("a transformed matrix is not positive definite")
    return _rows(out)


def diagnose(m: np.ndarray) -> pd.DataFrame:
    """A row per matrix; those that are not finite or not positive are flagged, not dropped."""
    n = len(m)
    finite = np.isfinite(m).all(axis=(-2, -1))
    out = {"finite": finite, "symmetry_error": np.full(n, np.inf), "min_eigenvalue": np.full(n, np.nan), "max_eigenvalue": np.full(n, np.nan), "condition_number": np.full(n, np.inf), "evd_error": np.full(n, np.inf)}
    if finite.any():
        x = m[finite]
        w, v = np.linalg.eigh(symmetrize(x))
        size = np.maximum(np.linalg.norm(x, axis=(-2, -1)), np.finfo(float).tiny)
        out["symmetry_error"][finite] = relative_asymmetry(x)
        out["min_eigenvalue"][finite], out["max_eigenvalue"][finite] = w[:, 0], w[:, -1]
        out["condition_number"][finite] = np.where(w[:, 0] > 0, w[:, -1] / np.where(w[:, 0] > 0, w[:, 0], 1), np.inf)
        out["evd_error"][finite] = np.linalg.norm((v * w[:, None, :]) @ np.swapaxes(v, -1, -2) - symmetrize(x), axis=(-2, -1)) / size
    out["is_spd"] = finite & (np.nan_to_num(out["min_eigenvalue"], nan=-1) > 0) & (out["symmetry_error"] <= 1e-10)
    return pd.DataFrame(out)


@F.pandas_udf(_DIAGNOSTICS)
def spd_diagnostics(c: pd.Series) -> pd.DataFrame:
    return diagnose(stack(c)) if len(c) else diagnose(np.zeros((0, 1, 1)))


def karcher(m: np.ndarray, tol: float = 1e-9, max_iter: int = 100) -> tuple[np.ndarray, float, int, list[str]]:
    """Affine-invariant mean by gradient steps that shrink when the gradient grows: mean, residual, steps, warnings."""
    mean, step, last, done = m.mean(axis=0), 1.0, np.inf, 0
    for done in range(1, max_iter + 1):
        root = sqrt(mean[None])[0]
        inverse = invsqrt(mean[None])[0]
        tangent = log(symmetrize(inverse @ m @ inverse)).mean(axis=0)
        size = float(np.linalg.norm(tangent))
        if size <= tol:
            break
        step = step * 0.95 if size < last else step * 0.5
        last = min(last, size)
        mean = symmetrize(root @ exp((step * tangent)[None])[0] @ root)
    residual = karcher_residual(mean, m)
    return mean, residual, done, [] if residual <= max(10 * tol, 1e-8) else ["no convergence"]


def karcher_residual(mean: np.ndarray, m: np.ndarray) -> float:
    """Norm of the mean logarithm at ``mean``, over the square root of the side."""
    inverse = invsqrt(mean[None])[0]
    return float(np.linalg.norm(log(symmetrize(inverse @ m @ inverse)).mean(axis=0)) / np.sqrt(len(mean)))
