"""Vectors and packed symmetric matrices as ``array<double>``, with higher-order functions only."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def cosine(a: Column, b: Column) -> Column:
    """NaN where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(dot(a, b) / size)


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def svec_dimension(n: int) -> int:
    return n * (n + 1) // 2


def matrix_side(dimension: int) -> int:
    """n of an svec of that many entries; an error where there is none."""
    n = (math.isqrt(8 * dimension + 1) - 1) // 2
    if n < 1 or svec_dimension(n) != dimension:
        raise ValueError(f"{dimension} entries are no packed symmetric matrix")
    return n


def svec(matrix: Column, n: int) -> Column:
    """Upper triangle of a row-major n x n array, row by row, off-diagonal entries times sqrt(2)."""
    return F.array(*[matrix[i * n + j] * (1.0 if i == j else math.sqrt(2)) for i in range(n) for j in range(i, n)])


def smat(packed: Column, n: int) -> Column:
    """Inverse of ``svec``."""
    place = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i, n))}
    return F.array(*[packed[place[min(i, j), max(i, j)]] / (1.0 if i == j else math.sqrt(2)) for i in range(n) for j in range(n)])


def group_mean_vector(df: DataFrame, by: list[str], vec: str, out: str = "mean", size: str = "fit_n") -> DataFrame:
    """Mean of each entry of ``vec`` by group, over rows that have one; a row carries its vector, not an entry each, into the partial aggregates."""
    rows = df.where(F.col(vec).isNotNull()).select(*by, array_to_vector(F.col(vec)).alias("v_vec"))
    return rows.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("v_vec"))).alias(out), F.count(F.lit(1)).alias(size))


def bound(value: Column, then) -> Column:
    """``then`` applied to ``value``, which is computed once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


# closed forms for a symmetric 2 x 2 matrix (a, b; b, d)

def eigenvalues2(a: Column, b: Column, d: Column) -> tuple[Column, Column]:
    half, gap = (a + d) / 2, F.sqrt(((a - d) / 2) * ((a - d) / 2) + b * b)
    return half - gap, half + gap


def function2(a: Column, b: Column, d: Column, f) -> Column:
    """f(matrix) as the array (a, b, b, d), through its two eigenvalues; equal ones give f times the identity."""
    def through(m):
        same = m["high"] == m["low"]
        slope = F.when(same, F.lit(0.0)).otherwise((m["fh"] - m["fl"]) / F.when(same, F.lit(1.0)).otherwise(m["high"] - m["low"]))
        return bound(F.struct(slope.alias("k"), (m["fl"] - slope * m["low"]).alias("c")), lambda s: F.array(s["k"] * m["a"] + s["c"], s["k"] * m["b"], s["k"] * m["b"], s["k"] * m["d"] + s["c"]))

    low, high = eigenvalues2(a, b, d)
    entries = F.struct(a.alias("a"), b.alias("b"), d.alias("d"), low.alias("low"), high.alias("high"))
    return bound(entries, lambda e: bound(F.struct(*[e[k].alias(k) for k in ("a", "b", "d", "low", "high")], f(e["low"]).alias("fl"), f(e["high"]).alias("fh")), through))
