"""Set hashes from sorted streams, ranked pairs, contracts, probability columns and model hashes."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from covarium.functions import digest, vectors
from covarium.operators import contracts, gates, learn, protocol, stats, trials, verdicts


def test_set_hashes(spark):
    rows = [("a", i % 3, f'u"{i}é') for i in range(500)] + [("a", 0, 'u"0é'), ("b", 1, "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # groups run over many batches
    got = {(r.k, r.s): (r.n, r.sha256) for r in digest.set_hashes(spark.createDataFrame(rows, "k string, s bigint, uid string"), ["k", "s"], "uid").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, s, u in rows:
        want.setdefault((k, s), set()).add(u)
    assert got == {k: (len(v), hashlib.sha256(json.dumps({"trial_uids": sorted(v)}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()) for k, v in want.items()}


def test_identity_audit_with_other_runs(spark):
    """A run outside both halves is evaluated under either split and calibrates none."""
    rows = [(s, "0train", str(t % 8), t, f"S{s}-{t}") for s in (1, 2) for t in range(16)]
    got = protocol.identity_audit(spark.createDataFrame(rows, "subject bigint, session string, run string, trial_id bigint, trial_uid string")).collect()
    one = {(r.protocol, r.split, r.role): r for r in got if r.target == 1}
    assert (one["T2", "A", "target_center_fit"].n_trials, one["T2", "A", "evaluation"].n_trials, one["T2", "B", "evaluation"].runs) == (6, 10, "0,1,2,6,7")
    uids = sorted(f"S1-{t}" for t in range(16) if t % 8 not in (0, 1, 2))
    assert one["T2", "A", "evaluation"].trial_uid_sha256 == hashlib.sha256(json.dumps({"trial_uids": uids}, separators=(",", ":")).encode()).hexdigest()
    assert all(r.relation_pass for r in got)


def test_ranked_pairs(spark):
    uids = [f"S1_é{i}" for i in (5, 3, 9, 1, 7, 2)]
    want = [(r.uid_left, r.uid_right) for r in trials.pair_top_k(spark.createDataFrame([(1, u) for u in uids], "subject bigint, trial_uid string"), 4).orderBy("rank").collect()]
    i, j = gates.ranked_pairs("1", uids, 4)
    assert [(uids[a], uids[b]) for a, b in zip(i, j)] == want


def test_contract_tables_and_joins(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), (None, 3), ("z", None)], "k string, v bigint")
    b = spark.createDataFrame([("x", 1), ("y", 5), (None, 3), ("w", None)], "k string, v bigint")
    got = {r.k: (r.expected, r.observed, r.passed) for r in contracts.compare(a, b, ["k"], "v").collect()}
    assert got == {"x": (1, 1, True), "y": (2, 5, False), None: (3, 3, True), "z": (None, None, False), "w": (None, None, False)}
    assert contracts.join_one_to_one(a, b.withColumnRenamed("v", "u"), "k").count() == 2
    with pytest.raises(contracts.ContractError):
        contracts.join_one_to_one(a, b.union(b), "k")
    assert contracts.lookup(b.where("k in ('x', 'y')").select("k"), a, "k", "v").count() == 2
    with pytest.raises(PySparkException):
        contracts.lookup(b.select("k"), a, "k", "v").collect()
    failed = spark.createDataFrame([("FAILED", "LE"), ("PASS", "LE"), ("FAILED", "LE")], "status string, geometry string")
    assert [tuple(r) for r in verdicts.failures(failed, ["geometry"]).collect()] == [("LE", 2)]


def test_probability_columns_and_model_hash(spark):
    df = spark.createDataFrame([(1, [0.25, 0.75])], "id bigint, probabilities array<double>")
    assert learn.probability_columns(df, ["a", "b"]).first().probability__b == 0.75
    with pytest.raises(ValueError):
        learn.probability_columns(df, ["a", "A"])
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([("ab"[i % 2], (rng.normal(size=2) + i % 2).tolist()) for i in range(60)], "y string, v array<double>").coalesce(1)
    model, names, _ = learn.fit_logistic(rows, "y", "v")
    other, *_ = learn.fit_logistic(rows, "y", "v", c=0.5)
    assert learn.model_hash(model, names) == learn.model_hash(model, names) != learn.model_hash(other, names)
    assert learn.model_hash(model, names) != learn.model_hash(model, names[::-1])
    cells = learn.confusion(rows.withColumn("p", F.lit("a")), "y", "p", ["a", "b"], ["p"]).withColumnRenamed("p", "by")
    got = learn.confusion_cells(cells, ["a", "b"], ["by"]).first()
    assert (got.cell__a__a, got.cell__b__a, got.cell__a__b) == (30, 30, 0)


def test_mean_vectors_and_subject_structure(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i % 2, x[i].tolist()) for i in range(40)] + [(0, None)], "subject bigint, v array<double>")
    got = {r.subject: r for r in vectors.group_mean_vector(df, ["subject"], "v").collect()}
    assert all(np.allclose(got[s]["mean"], x[s::2].mean(axis=0)) and got[s].fit_n == 20 for s in (0, 1))
    far = df.where("v is not null").withColumn("v", F.transform("v", lambda e: e + 50 * F.col("subject")))
    one = stats.subject_structure(far, "v").first()
    assert one.silhouette > 0.9 and one.separation_ratio > 10 and one.n == 40
