"""The driver tables as trials, windows, covariances, coordinates and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.operators import covariance, trials
from covarium.sources.readers import table

WINDOWS, SAMPLES = 5, 45
CHANNELS = ("l_quantity / 50", "l_extendedprice / 100000", "l_discount * 10", "l_tax * 10")


def trial_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials from events; event_id, unique, stands for the sample index."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = e.select(F.col("event_id").alias("sample_index"), (F.col("user_id") % 9 + 1).alias("subject"), F.lit("0train").alias("session"), F.col("event_type").alias("class_label"), "ts")
    out = trials.with_identity(e, ["ts", "sample_index"], F.to_date("ts"))
    return out.select("sample_index", "subject", "session", "run", "trial_id", "run_trial_id", "trial_uid", "class_label")


def window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 45 events of each user in five windows: user_id, event_type, value, sample, window_index."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return covariance.assign_windows(e, ["user_id"], ["ts", "event_id"], WINDOWS, SAMPLES)


def window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per user and window, as a vector of one entry."""
    m = window_samples(spark, sf_dir).groupBy("user_id", "window_index").agg(F.avg("value").alias("m"))
    return m.select("user_id", (F.col("user_id") % 3).cast("string").alias("class_label"), "window_index", F.array("m").alias("z"))


def covariances(spark: SparkSession, sf_dir: str, channels: int = 2) -> DataFrame:
    """OAS covariances of line items by supplier and return flag; subject and class from these."""
    li = table(spark, sf_dir, "lineitem")
    c = covariance.of_samples(li, ["l_suppkey", "l_returnflag"], [F.expr(x) for x in CHANNELS[:channels]])
    return c.withColumn("subject", F.col("l_suppkey") % 9 + 1)


def coordinates(spark: SparkSession, sf_dir: str, subjects: int = 9) -> DataFrame:
    """Embeddings as double vectors with a subject."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % subjects + 1).alias("subject"), F.col("embedding").cast("array<double>").alias("coords"))
