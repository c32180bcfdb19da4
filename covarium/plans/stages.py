"""Stages that run one after another in a session, each from the written result of the one before.

    python -m covarium prepare|covariances|coordinates|diagnostics|gate|loso|report|all --input DIR --output DIR

``--input`` holds ``trials`` (Parquet: the identity columns, class_label and signal).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covarium.operators import centers, contracts, covariance, gates, learn, protocol, stats, trials
from covarium.plans import report
from covarium.sources import sinks

KEY = ["subject", "session", "run", "trial_id", "trial_uid", "class_label"]


def _read(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def prepare(spark: SparkSession, src: str, out: str) -> None:
    """Trials, checked: unique identities, one class per trial."""
    t = trials.normalise_aliases(spark.read.parquet(f"{src}/trials"))
    contracts.require_empty(contracts.duplicates(t, ["trial_uid"]), "trial_uid repeats")
    contracts.require_empty(contracts.functional_violations(t, ["subject", "session", "trial_id"], "class_label"), "a trial has several classes")
    sinks.parquet(t.select(*KEY, "signal"), f"{out}/trials", "overwrite")


def covariances(spark: SparkSession, src: str, out: str) -> None:
    c = covariance.of_epochs(_read(spark, out, "trials"), KEY)
    sinks.parquet(covariance.sanity(c), f"{out}/covariances", "overwrite")
    sinks.csv(covariance.sanity_summary(_read(spark, out, "covariances"), ["representation"]), f"{out}/covariance_summary", "overwrite")


def coordinates(spark: SparkSession, src: str, out: str) -> None:
    c = _read(spark, out, "covariances").drop("check")
    z = centers.center_coordinates(centers.with_log(c), ["representation", "subject"])
    sinks.parquet(z.drop("log_mean", "fit_n"), f"{out}/coordinates", "overwrite")
    left = centers.residual(_read(spark, out, "coordinates"), ["representation", "subject"]).first()[0]
    if left is not None and left > 1e-10:
        raise contracts.ContractError(f"centered means are {left}, not 0")


def whole_trials(window: DataFrame, most: int = stats.SILHOUETTE_ROWS // 5) -> DataFrame:
    """All windows of a balanced subset of about ``most`` trials."""
    chosen = trials.balanced_subset(window.select("subject", "class_label", "trial_uid").distinct(), most)
    return window.join(chosen.select("trial_uid"), "trial_uid", "left_semi")


def diagnostics(spark: SparkSession, src: str, out: str) -> None:
    z = _read(spark, out, "coordinates")
    whole, window = z.where("representation = 'WHOLE'"), z.where("representation = 'WINDOW5'")
    contracts.require_empty(contracts.incomplete_windows(window, ["trial_uid"]), "a trial lacks windows")
    found = None
    for name, df in (("whole", whole), ("window5", window)):
        for state, vec in (("raw", "coords"), ("centered", "centered")):
            sample = whole_trials(df) if name == "window5" and df.count() > stats.SILHOUETTE_ROWS else None
            part = stats.separability(df, vec, {"class": "class_label", "subject": "subject"}, f"{name}_{state}", "window_index" if name == "window5" else None, sample)
            found = part if found is None else found.unionByName(part)
    sinks.csv(found, f"{out}/separability_metrics", "overwrite")
    fold = trials.folds(whole.select(*KEY), 5, trials.SEED, [("subject", "int"), ("session", "str"), ("trial_id", "int")]).select("trial_uid", "fold")
    probes = None
    for name, df in (("whole", whole), ("window5", window)):
        rows = df.join(fold, "trial_uid").withColumn("subject_label", F.col("subject").cast("string")).persist()
        for state, vec in (("raw", "coords"), ("centered", "centered")):
            for target, label in (("class", "class_label"), ("subject", "subject_label")):
                part = learn.probe_summary(learn.logistic_probe(rows, label, vec), label).withColumn("representation", F.lit(name)).withColumn("state", F.lit(state)).withColumn("target", F.lit(target))
                probes = part if probes is None else probes.unionByName(part)
    sinks.csv(probes, f"{out}/linear_probe_metrics", "overwrite")
    steps = stats.transition_steps(window, ["trial_uid", "class_label"], "window_index", "coords")
    sinks.csv(stats.descriptive(steps, "class_label", "window_pair", "magnitude"), f"{out}/transition_summary", "overwrite")
    sinks.csv(stats.class_cosines(steps, "class_label", "window_pair"), f"{out}/transition_cosines", "overwrite")
    sinks.csv(stats.eta_squared(steps, "class_label", "magnitude", ["window_pair"]), f"{out}/transition_effects", "overwrite")


def gate(spark: SparkSession, src: str, out: str) -> None:
    whole = _read(spark, out, "covariances").where("representation = 'WHOLE'")
    both = protocol.calibration_halves(whole).where("part = 'calibration'").withColumn("protocol", F.lit("T2")).select("subject", "protocol", "split", "trial_uid", "cov")
    scopes = whole.select("subject", F.lit("T1").alias("protocol"), F.lit("ALL").alias("split"), "trial_uid", "cov").unionByName(both)
    by = ["subject", "protocol", "split"]
    sinks.parquet(gates.gate_rows(gates.evaluate_scopes(scopes, by), by), f"{out}/gate", "overwrite")
    payload = gates.gate_payload(_read(spark, out, "gate")).first().asDict()
    sinks.json_file(f"{out}/gate.json", payload)
    if not payload["classification_allowed"]:
        raise gates.GateError("the geometry gate failed")


def loso(spark: SparkSession, src: str, out: str) -> None:
    with open(f"{out}/gate.json", encoding="utf-8") as f:
        gates.require_gate(f.read(), _read(spark, out, "gate"))
    z = _read(spark, out, "coordinates").where("representation = 'WHOLE'")
    sinks.parquet(protocol.loso(z, "class_label"), f"{out}/loso", "overwrite")
    sinks.parquet(protocol.loso(z, "class_label", geometries=("AIRM", "EA")), f"{out}/loso_matrix", "overwrite")
    sinks.parquet(protocol.loso_mdm(z, "class_label"), f"{out}/loso_mdm", "overwrite")
    fold = trials.folds(z.select(*KEY), 5, trials.SEED, [("subject", "int"), ("session", "str"), ("trial_id", "int")]).select("trial_uid", "fold")
    sinks.parquet(protocol.leakage_audit(z.join(fold, "trial_uid"), "subject", "class_label", "fold", "coords", 5), f"{out}/leakage_audit", "overwrite")
    sinks.parquet(protocol.identity_audit(z), f"{out}/identity_audit", "overwrite")
    c = _read(spark, out, "covariances").where("representation = 'WHOLE'").select("subject", "cov")
    sinks.parquet(stats.compare_means(*(centers.fit_centers(c, g, ["subject"]) for g in ("LE", "AIRM", "EA")), ["subject"]), f"{out}/mean_comparison", "overwrite")
    sinks.parquet(stats.domain_shift(z, "subject"), f"{out}/domain_shift", "overwrite")


def write_report(spark: SparkSession, src: str, out: str) -> None:
    results = _read(spark, out, "loso").unionByName(_read(spark, out, "loso_matrix"))
    mdm, leakage = _read(spark, out, "loso_mdm").orderBy("target", "geometry", "metric", "protocol", "split"), _read(spark, out, "leakage_audit").orderBy("condition", "fold")
    failed = results.where("status = 'FAILED'").count()
    t1, t2 = (report.verdicts.ba_pivot(results, s, subject="target") for s in ("ALL", "AGGREGATE"))
    failed += sum(t.where("RAW is null or LE is null or AIRM is null").count() for t in (t1, t2))  # an absent geometry leaves the questions open, too
    text = dict.fromkeys(report.SECTIONS, "See the tables beside this report.")
    text["Geometry correctness"] = report.markdown(gates.gate_payload(_read(spark, out, "gate")))
    text["LE vs AIRM Fréchet means"] = report.markdown(_read(spark, out, "mean_comparison"))
    text["LOSO transductive results"], text["Calibration-to-held-out-run results"] = report.markdown(t1), report.markdown(t2)
    text["Metric-native MDM sanity check"], text["V1 leakage audit"] = report.markdown(mdm), report.markdown(leakage)
    text["Marginal domain diagnostics"] = report.markdown(_read(spark, out, "domain_shift"))
    text["Frozen decision-rule verdicts"] = report.markdown(report.verdicts.questions(t1, t2, failed))
    rows = results.select("status", "geometry", F.lit("logistic").alias("kind"), F.lit("native").alias("metric")).unionByName(mdm.select("status", "geometry", F.lit("mdm").alias("kind"), "metric"))
    lost = report.verdicts.failures(rows, ["kind", "geometry", "metric"]).orderBy("kind", "geometry", "metric")
    text["What is NOT justified"] = report.markdown(lost) if lost.limit(1).count() else "No fit failed; anything beyond the subjects, runs and decoders above is not shown."
    means = _read(spark, out, "mean_comparison")
    figures = report.figure_sources(results, means, leakage)
    blocks = {"t1": t1, "t2": t2, "failures": lost, "domain_shift": _read(spark, out, "domain_shift")}
    report.write(out, report.render("Geometry audit", text), {"loso_results": results, "mdm_results": mdm, "leakage_audit_results": leakage, "geometry_summary": report.long_summary(blocks), **figures})


STAGES = {"prepare": prepare, "covariances": covariances, "coordinates": coordinates, "diagnostics": diagnostics, "gate": gate, "loso": loso, "report": write_report}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="covarium", description=__doc__)
    parser.add_argument("stage", choices=[*STAGES, "all"])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("covarium").getOrCreate()
    for name in STAGES if got.stage == "all" else [got.stage]:
        STAGES[name](spark, got.input, got.output)
    print(json.dumps({"stage": got.stage, "output": got.output}))
    return 0
