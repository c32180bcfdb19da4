"""Hash-pinned scans, with a recomputation where only the reused covariances don't fit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.functions.digest import content_hash


class DataContractError(ValueError):
    """A pinned input isn't what it was."""


class CovarianceIdentityError(DataContractError):
    """Reused covariances aren't those of the pinned trials."""


def fingerprint(df: DataFrame) -> str:
    """Order-free hash of a table's content: column by column in name order, nulls told apart from texts."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return df.select(row.alias("h")).agg(content_hash(F.col("h")).alias("h")).first().h


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read by executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def pinned(df: DataFrame, expected: str, error: type[DataContractError] = DataContractError) -> DataFrame:
    found = fingerprint(df)
    if found != expected:
        raise error(f"content hash {found}, not {expected}")
    return df


def reuse_or_recompute(load: Callable[[], DataFrame], expected: str, recompute: Callable[[], DataFrame], cache: str) -> tuple[DataFrame, bool]:
    """The pinned table, or, if only its identity fails, a recomputed one written to ``cache``; whether it was reused."""
    try:
        return pinned(load(), expected, CovarianceIdentityError), True
    except CovarianceIdentityError:
        made = recompute()
        made.write.mode("errorifexists").parquet(cache)
        return made.sparkSession.read.schema(made.schema).parquet(cache), False
