"""Threshold verdicts over small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.operators.trials import sign_category

SUPPORTED, MIXED, NOT_SUPPORTED = "SUPPORTED", "MIXED", "NOT SUPPORTED"
#: Thresholds of the hypotheses.  Fixed values.
H_THRESHOLDS = {
    "metric_silhouette_delta": 0.02,
    "probe_accuracy_delta": 0.02,
    "above_chance_margin": 0.05,
    "window_silhouette_range": 0.02,
    "distance_ratio_relative_delta": 0.05,
    "transition_eta_squared": 0.01,
    "transition_mean_range_fraction": 0.05,
}
#: Thresholds and wording of the questions.  Fixed values.
Q_RULES = {
    "sign_tolerance": 1e-12,
    "mean_delta_min": 0.01,
    "improved_subjects_min": 6,
    "mean_delta_difference_min": 0.02,
    "subject_sign_disagreements_min": 4,
    "absolute_mean_ba_difference_min": 0.02,
    "technical_failure": "UNASSESSED — TECHNICAL FAILURE",
    "Q1": ("NOT SUPPORTED", "GEOMETRY-SENSITIVE-MIXED", "ROBUSTLY SUPPORTED"),
    "Q2": ("NOT SUPPORTED", "SUPPORTED"),
    "Q3": ("SMALL IN THIS PILOT", "POTENTIALLY IMPORTANT"),
}


def vote(value, threshold, both_ways: bool):
    """Column: 1 from the threshold on, -1 from its negative down if ``both_ways``, else 0."""
    out = F.when(value >= threshold, 1)
    return (out.when(value <= -threshold, -1) if both_ways else out).otherwise(0)


def hypotheses(evidence: DataFrame) -> DataFrame:
    """Verdicts from evidence rows (hypothesis, part, value, threshold, both_ways): hypothesis, positives, negatives, n, verdict.

    H1 needs two positive votes and no negative one; H2 and H3 two in each of their parts
    (H3 without a negative); H4 to H6 all.  Some positive or negative vote makes it mixed.
    """
    v = F.when(F.col("both_ways"), vote(F.col("value"), F.col("threshold"), True)).otherwise(vote(F.col("value"), F.col("threshold"), False))
    parts = evidence.withColumn("v", v).groupBy("hypothesis", "part").agg(F.sum((F.col("v") > 0).cast("long")).alias("pos"), F.sum((F.col("v") < 0).cast("long")).alias("neg"), F.count(F.lit(1)).alias("n"))
    h = parts.groupBy("hypothesis").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("n").alias("n"), F.min("pos").alias("least"))
    name = F.col("hypothesis")
    full = F.when(name == "H1", (F.col("positives") >= 2) & (F.col("negatives") == 0)).when(name == "H2", F.col("least") >= 2).when(name == "H3", (F.col("least") >= 2) & (F.col("negatives") == 0)).otherwise(F.col("positives") >= F.col("n"))
    some = F.when(name.isin("H1", "H3"), (F.col("positives") > 0) | (F.col("negatives") > 0)).otherwise(F.col("positives") > 0)
    return h.withColumn("verdict", F.when(full, SUPPORTED).when(some, MIXED).otherwise(NOT_SUPPORTED)).drop("least")


def distinctions(verdicts: DataFrame) -> DataFrame:
    """One row (a, b, c) from H1, H4 and H6."""
    w = verdicts.agg(*[F.max(F.when(F.col("hypothesis") == h, F.col("verdict"))).alias(h) for h in ("H1", "H4", "H6")])
    a = F.when(F.col("H1") == SUPPORTED, SUPPORTED).when((F.col("H1") == MIXED) | F.col("H4").isin(SUPPORTED, MIXED), MIXED).otherwise(NOT_SUPPORTED)
    w = w.withColumn("a", a).withColumn("b", F.col("H6"))
    c = F.when((F.col("a") == NOT_SUPPORTED) & (F.col("b") == NOT_SUPPORTED), SUPPORTED).when((F.col("a") != SUPPORTED) & (F.col("b") != SUPPORTED), MIXED).otherwise(NOT_SUPPORTED)
    return w.select("a", "b", c.alias("c"))


def ba_pivot(results: DataFrame, split: str, value: str = "balanced_accuracy", subject: str = "subject") -> DataFrame:
    """subject, RAW, LE, AIRM, EA."""
    return results.where(F.col("split") == split).groupBy(subject).pivot("geometry", ["RAW", "LE", "AIRM", "EA"]).agg(F.first(value))


def subject_deltas(t1: DataFrame, subject: str = "subject", tolerance: float = Q_RULES["sign_tolerance"]) -> DataFrame:
    """Differences to RAW and their categories from a pivot; null where either failed."""
    out = t1
    for g in ("LE", "AIRM", "EA"):
        d = F.col(g) - F.col("RAW")
        out = out.withColumn(f"delta_{g}", d).withColumn(f"category_{g}", F.when(d.isNull(), "unassessed_technical_failure").otherwise(sign_category(d, tolerance)))
    return out.select(subject, *[f"{k}_{g}" for g in ("LE", "AIRM", "EA") for k in ("delta", "category")])


def questions(t1: DataFrame, t2: DataFrame, failures: int = 0, rules: dict = Q_RULES) -> DataFrame:
    """(question, verdict) from the pivots of both protocols; any failed primary row leaves all unassessed."""
    if failures:
        return t1.sparkSession.createDataFrame([(q, rules["technical_failure"]) for q in ("Q1", "Q2", "Q3")], "question string, verdict string")
    d = subject_deltas(t1, next(c for c in t1.columns if c not in ("RAW", "LE", "AIRM", "EA")))
    better = lambda g: F.sum((F.col(f"category_{g}") == "improved").cast("int"))
    a = d.agg(F.avg("delta_LE").alias("le"), F.avg("delta_AIRM").alias("airm"), better("LE").alias("le_n"), better("AIRM").alias("airm_n"), F.sum((F.col("category_LE") != F.col("category_AIRM")).cast("int")).alias("odd"))
    m1 = t1.agg(F.avg("LE").alias("le1"), F.avg("AIRM").alias("airm1"))
    m2 = t2.agg(F.avg("LE").alias("le2"), F.avg("AIRM").alias("airm2"))
    one = a.crossJoin(m1).crossJoin(m2)  # single rows
    t = rules["sign_tolerance"]
    ok = lambda g: ((F.col(g) >= rules["mean_delta_min"]) & (F.col(f"{g}_n") >= rules["improved_subjects_min"])).cast("int")
    q1 = F.get(F.array(*map(F.lit, rules["Q1"])), ok("le") + ok("airm"))
    apart = (F.abs(F.col("le") - F.col("airm")) >= rules["mean_delta_difference_min"]) | ((F.col("le") > t) & (F.col("airm") < -t)) | ((F.col("le") < -t) & (F.col("airm") > t)) | (F.col("odd") >= rules["subject_sign_disagreements_min"])
    far = (F.abs(F.col("le1") - F.col("le2")) >= rules["absolute_mean_ba_difference_min"]) | (F.abs(F.col("airm1") - F.col("airm2")) >= rules["absolute_mean_ba_difference_min"])
    rows = F.array(*[F.struct(F.lit(q).alias("question"), v.alias("verdict")) for q, v in (("Q1", q1), ("Q2", F.when(apart, rules["Q2"][1]).otherwise(rules["Q2"][0])), ("Q3", F.when(far, rules["Q3"][1]).otherwise(rules["Q3"][0])))])
    return one.select(F.inline(rows))


def aggregate_identity(results: DataFrame, by: list[str], value: str = "balanced_accuracy", tolerance: float = 1e-12) -> DataFrame:
    """Rows whose AGGREGATE differs from the mean of splits A and B; must be empty."""
    r = results.groupBy(*by).agg(F.avg(F.when(F.col("split").isin("A", "B"), F.col(value))).alias("mean_ab"), F.max(F.when(F.col("split") == "AGGREGATE", F.col(value))).alias("aggregate"))
    return r.where(F.abs(F.col("mean_ab") - F.col("aggregate")) > tolerance)


def failures(results: DataFrame, by: list[str]) -> DataFrame:
    """Failed rows by ``by`` (source, kind, geometry, metric): by, n."""
    return results.where("status = 'FAILED'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
