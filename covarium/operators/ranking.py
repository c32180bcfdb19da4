"""Running numbers that don't put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_number(df: DataFrame, by: list[str], order: list, coarse: Column, name: str) -> DataFrame:
    """1-based running number within ``by`` in the total order ``order``.

    ``coarse`` doesn't decrease along ``order`` and cuts a group into small runs: rows are
    numbered within (by, coarse), and each run starts where the counts of the runs before
    it end.  Those counts are one row per run, partially aggregated.
    """
    rows = df.withColumn("n_run", coarse)
    counts = rows.groupBy(*by, "n_run").agg(F.count(F.lit(1)).alias("n_count"))
    before = F.coalesce(F.sum("n_count").over(W.partitionBy(*by).orderBy("n_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(b).alias(f"rk_{b}") for b in by], F.col("n_run").alias("n_key"), before.alias("n_start"))
    same = F.col("n_run").eqNullSafe(F.col("n_key"))
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"rk_{b}"))
    local = F.row_number().over(W.partitionBy(*by, "n_run").orderBy(*order))
    out = rows.withColumn("n_local", local).join(starts, same).withColumn(name, (F.col("n_local") + F.col("n_start")).cast("long"))
    return out.drop("n_run", "n_key", "n_start", "n_local", *[f"rk_{b}" for b in by])
