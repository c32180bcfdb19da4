"""Scans with explicit schemas.  A column that isn't asked for isn't read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCHS = "trial_uid string, n_channels int, n_samples int, signal array<array<float>>"
TRIALS = "sample_index bigint, subject bigint, session string, run string, trial_id bigint, run_trial_id bigint, trial_uid string, class_label string"
COVARIANCES = f"{TRIALS}, representation string, window_index bigint, n int, cov array<double>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, path: str) -> DataFrame:
    """Prepared trials, a row each; finite samples and one shape are checked as rows pass."""
    df = spark.read.schema(EPOCHS).parquet(path)
    fits = (F.size("signal") == F.col("n_channels")) & F.forall("signal", lambda c: (F.size(c) == F.col("n_samples")) & F.forall(c, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return df.withColumn("signal", F.when(fits, F.col("signal")).otherwise(F.raise_error(F.concat(F.lit("bad signal in "), F.col("trial_uid"))).cast("array<array<float>>")))


def csv(spark: SparkSession, path: str, schema: str = TRIALS) -> DataFrame:
    """CSV with a header and forced types: ``run`` "0" stays a string."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def json_object(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object as one row; an error for another top level."""
    text = spark.read.text(path, wholetext=True)
    kind = text.select(F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("k")).first()
    if kind is None or kind.k != "{":
        raise ValueError(f"{path} holds no JSON object")
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
