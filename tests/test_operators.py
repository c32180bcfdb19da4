"""Algebra, brute force, invariance and failure cases of the operators."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from covarium.functions import digest, spd, vectors
from covarium.operators import centers, contracts, covariance, gates, learn, protocol, ranking, stats, trials, verdicts
from covarium.plans import report
from covarium.sources import config, fixity, readers, sinks

RNG = np.random.default_rng(20260809)


def matrices(n, p):
    f = RNG.normal(size=(n, p, p))
    return f @ np.swapaxes(f, 1, 2) + 0.2 * np.eye(p)


def covs(spark, n=30, p=3, groups=3):
    m = matrices(n, p)
    return spark.createDataFrame([(i, i % groups, f"c{i % 2}", m[i].ravel().tolist()) for i in range(n)], "i bigint, g bigint, class_label string, cov array<double>"), m


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


# --- digests and ranks

def test_digests(spark):
    typed = lambda vs: hashlib.sha256(json.dumps({"seed": 3, "values": [{"type": k, "value": str(v)} for v, k in vs]}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, digest.typed_digest(3, [(F.lit(1), "int"), (F.lit('é"\\'), "str")])) == typed([(1, "int"), ('é"\\', "str")])
    assert typed([(1, "int")]) != typed([(1, "str")])
    pair = json.dumps([7, "2", "a", 'b"'], ensure_ascii=False, separators=(",", ":"))
    assert one(spark, digest.pair_digest(7, F.lit(2), F.lit("a"), F.lit('b"'))) == hashlib.sha256(pair.encode()).hexdigest()
    uids = json.dumps({"trial_uids": ["a", "b", "c"]}, separators=(",", ":"))
    assert one(spark, digest.uid_set_hash(F.array(*map(F.lit, "cab")))) == hashlib.sha256(uids.encode()).hexdigest()


def test_running_number_matches_row_number(spark):
    from pyspark.sql import Window as W

    df = spark.range(500).select(F.pmod("id", F.lit(3)).alias("g"), F.xxhash64("id").alias("k"), "id")
    got = ranking.running_number(df, ["g"], ["k"], F.floor(F.col("k") / (1 << 60)), "n")
    want = df.withColumn("m", F.row_number().over(W.partitionBy("g").orderBy("k")))
    assert got.join(want.select("id", "m"), "id").where("n <> m").count() == 0


def test_folds_ignore_row_order(spark):
    t = spark.range(90).select((F.col("id") % 3).alias("subject"), (F.col("id") % 2).cast("string").alias("class_label"), F.col("id").alias("trial_id"))
    a = trials.folds(t, 5, 1, [("subject", "int"), ("trial_id", "int")])
    b = trials.folds(t.orderBy(F.desc("trial_id")), 5, 1, [("subject", "int"), ("trial_id", "int")])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r["count"] for r in a.groupBy("subject", "class_label", "fold").count().collect()} == {3}
    assert trials.small_strata(t, 16).count() == 6 and trials.small_strata(t, 15).count() == 0


def test_strict_casts(spark):
    s = spark.createDataFrame([("1",), ("2.0",)], "x string")
    assert [r.x for r in s.select(trials.strict_long(F.col("x")).alias("x")).collect()] == [1, 2]
    for bad in ("1.5", "x", None):
        with pytest.raises(Exception, match="no whole number"):
            spark.createDataFrame([(bad,)], "x string").select(trials.strict_long(F.col("x"))).collect()
    with pytest.raises(Exception, match="no boolean"):
        one(spark, trials.strict_boolean(F.lit("1")))
    assert one(spark, trials.strict_boolean(F.lit("1"), digits=True)) and not one(spark, trials.strict_boolean(F.lit("False")))


def test_names(spark):
    assert one(spark, trials.token(F.lit("  A--b C! "))) == "a_b_c"
    assert one(spark, trials.canonical_representation(F.lit("WINDOW5"), F.lit("Centered"))) == "window5_centered"
    assert one(spark, trials.canonical_metric(F.lit("Subject silhouette"))) == "subject_silhouette" and one(spark, trials.canonical_metric(F.lit("other"))) is None
    with pytest.raises(Exception, match="unknown"):
        one(spark, trials.canonical_representation(F.lit("x"), F.lit("raw")))


# --- matrices

def test_pack_is_isometric(spark):
    m = matrices(4, 5)
    assert np.allclose(spd.unpack(spd.pack(m)), m)
    assert np.allclose(np.linalg.norm(spd.pack(m), axis=1), np.linalg.norm(m, axis=(1, 2)))
    got = one(spark, vectors.svec(F.array(*[F.lit(float(x)) for x in m[0].ravel()]), 5))
    assert np.allclose(got, spd.pack(m[0]))
    assert np.allclose(one(spark, vectors.smat(F.array(*[F.lit(float(x)) for x in got]), 5)), m[0].ravel())
    assert [vectors.matrix_side(vectors.svec_dimension(n)) for n in (1, 2, 22)] == [1, 2, 22]
    with pytest.raises(ValueError):
        vectors.matrix_side(4)


def test_spectral_functions():
    m = matrices(6, 4)
    assert np.allclose(spd.exp(spd.log(m)), m)
    w = spd.invsqrt(m)
    assert np.allclose(w @ m @ w, np.eye(4))
    a, b, g = m[:3], m[3:], RNG.normal(size=(4, 4))
    assert np.allclose(spd.airm(a, b), spd.airm(spd.symmetrize(g @ a @ g.T), spd.symmetrize(g @ b @ g.T)))
    with pytest.raises(ValueError, match="positive"):
        spd.log(np.diag([1.0, 0.0])[None])
    with pytest.raises(ValueError, match="symmetric"):
        spd.log(np.array([[[1.0, 0.5], [0.0, 1.0]]]))
    d = spd.diagnose(np.stack([np.eye(2), np.diag([1.0, -1.0]), np.full((2, 2), np.nan)]))
    assert d["is_spd"].tolist() == [True, False, False] and np.isinf(d["condition_number"][1:]).all()


def test_function2_agrees_with_eigh(spark):
    m = matrices(1, 2)[0]
    got = spark.range(1).select(vectors.function2(F.lit(float(m[0, 0])), F.lit(float(m[0, 1])), F.lit(float(m[1, 1])), F.log).alias("z")).first().z
    assert np.allclose(got, spd.log(m[None])[0].ravel())


def test_oas_long_and_array_agree(spark):
    x = RNG.normal(size=(3, 40)) * [[1], [2], [0.5]]
    long = spark.createDataFrame([(1, *map(float, x[:, t])) for t in range(40)], "k bigint, a double, b double, c double")
    got = covariance.of_samples(long, ["k"], [F.col(c) for c in "abc"]).first()
    assert np.allclose(got.cov, covariance.oas(x).ravel(), atol=1e-12) and 0 < got.shrinkage <= 1
    e = spark.createDataFrame([(1, x.tolist())], "k bigint, signal array<array<double>>")
    rows = covariance.of_epochs(e, ["k"], 5).orderBy(F.col("window_index").asc_nulls_first()).collect()
    assert [r.window_index for r in rows] == [None, 1, 2, 3, 4, 5] and np.allclose(rows[0].cov, got.cov)
    assert np.allclose(rows[3].cov, covariance.oas(x[:, 16:24]).ravel())
    for bad in ((41, 5), (5, 5)):
        with pytest.raises(ValueError):
            covariance.window_slices(*bad)
    with pytest.raises(ValueError):
        covariance.oas(np.full((2, 5), np.nan))


def test_sanity_keeps_bad_rows(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 1.0]), ("a", [1.0, 0.0, 0.0, -1.0]), ("a", [float("nan"), 0.0, 0.0, 1.0])], "representation string, cov array<double>")
    r = covariance.sanity_summary(covariance.sanity(df), ["representation"]).first()
    assert (r.n, r.n_spd, r.n_non_spd, r.n_non_finite) == (3, 1, 2, 1) and r.max_condition == float("inf")


# --- centers

@pytest.mark.parametrize("geometry", ["RAW", "LE", "AIRM", "EA"])
def test_centers(spark, geometry):
    df, m = covs(spark)
    c = centers.fit_centers(df.select("g", "cov"), geometry, ["g"])
    assert {r.fit_n for r in c.collect()} == ({0} if geometry == "RAW" else {10})
    moved = centers.transform(df, c, geometry, ["g"])
    got = np.array([r.cov for r in moved.orderBy("i").collect()]).reshape(-1, 3, 3)
    if geometry == "RAW":
        assert np.allclose(got, m)
        return
    for g in range(3):
        x = got[g::3]
        mean = {"LE": spd.exp(spd.log(x).mean(0)[None])[0], "EA": x.mean(0), "AIRM": spd.karcher(x)[0]}[geometry]
        assert np.allclose(mean, np.eye(3), atol=1e-6)
    with pytest.raises(ValueError, match="must not see"):
        centers.fit_centers(df, geometry, ["g"])


def test_karcher_forms_agree(spark):
    df, m = covs(spark, 12, 2, 2)
    a = centers.karcher_centers(df, ["g"]).orderBy("g").collect()
    b = centers.karcher_centers(df.coalesce(1), ["g"], grouped_rows=1).orderBy("g").collect()
    for x, y in zip(a, b):
        assert x.karcher_residual < 1e-7 and y.karcher_residual < 1e-7 and np.allclose(x.mean, y.mean, atol=1e-7)
    assert max(r.distance for r in centers.crosscheck(df, ["g"]).collect()) < 1e-6


def test_le_centering_is_subtraction(spark):
    df, m = covs(spark)
    z = centers.center_coordinates(centers.with_log(df), ["g"])
    assert centers.residual(z, ["g"]).first().max_abs < 1e-12
    moved = centers.transform(df, centers.fit_centers(df.select("g", "cov"), "LE", ["g"]), "LE", ["g"]).withColumn("w", spd.log_svec("cov"))
    a, b = (np.array([r[0] for r in x.orderBy("i").select(c).collect()]) for x, c in ((z, "centered"), (moved, "w")))
    assert np.allclose(a, b, atol=1e-10)


# --- statistics

def vecs(spark, n=40, d=4):
    x, y = RNG.normal(size=(n, d)), RNG.integers(0, 3, n)
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "i bigint, y bigint, v array<double>"), x, y


def test_rms_ratio_brute(spark):
    df, x, y = vecs(spark)
    i, j = np.triu_indices(len(x), 1)
    d = ((x[i] - x[j]) ** 2).sum(1)
    same = y[i] == y[j]
    r = stats.rms_distance_ratio(df, "y", "v").first()
    assert r.within == pytest.approx(np.sqrt(d[same].mean()), rel=1e-10) and r.between == pytest.approx(np.sqrt(d[~same].mean()), rel=1e-10)


def test_silhouette_brute(spark):
    df, x, y = vecs(spark)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for k in range(len(x)):
        own = y == y[k]
        if own.sum() == 1:
            s.append(0)
            continue
        a, b = d[k, own].sum() / (own.sum() - 1), min(d[k, y == c].mean() for c in set(y) - {y[k]})
        s.append((b - a) / max(a, b))
    assert stats.silhouette(df, "y", "v").first().silhouette == pytest.approx(np.mean(s), abs=1e-12)
    with pytest.raises(ValueError):
        stats.silhouette(df, "y", "v", max_rows=10)
    with pytest.raises(ValueError):
        stats.silhouette(df.withColumn("y", F.lit(1)), "y", "v")


def test_eta_and_steps(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 7.0)], "g string, v double")
    assert stats.eta_squared(df, "g", "v").first().eta_squared == pytest.approx(16 / 20)
    assert stats.eta_squared(df.withColumn("v", F.lit(2.0)), "g", "v").first().eta_squared == 0
    w = spark.createDataFrame([(t, k, "c", [float(k * k), float(t)]) for t in range(3) for k in range(1, 6)], "t bigint, w bigint, c string, v array<double>")
    s = stats.transition_steps(w, ["t"], "w", "v")
    assert sorted({(r.window_pair, r.magnitude) for r in s.collect()}) == [("1-2", 3.0), ("2-3", 5.0), ("3-4", 7.0), ("4-5", 9.0)]
    moved = stats.transition_steps(w.withColumn("v", F.transform("v", lambda x: x + 10)), ["t"], "w", "v")
    assert stats.invariance(s, moved, ["t", "window_pair"]).first().holds
    six = {r.g: r for r in stats.six_numbers(df.union(spark.createDataFrame([("z", 1.0)], "g string, v double")), ["g"], "v").collect()}
    assert np.isnan(six["z"].std) and six["a"].median == 2.0
    assert {r["std"] for r in stats.descriptive(s.where("t = 0"), "c", "window_pair", "magnitude").where("scope <> 'all'").collect()} == {0.0}


# --- learning

def test_metrics_and_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("a", "c")], "t string, p string")
    cells = learn.confusion(df, "t", "p", ["a", "b", "c"])
    assert cells.count() == 9
    r = learn.metrics(cells).first()
    assert (r.n, r.accuracy) == (5, 0.6) and r.balanced_accuracy == pytest.approx((1 / 3 + 1) / 2) and r.macro_f1 == pytest.approx((0.5 + 0.8 + 0) / 3)
    assert r.recalls == pytest.approx([1 / 3, 1.0, 0.0])


def test_logistic_minimises_its_objective(spark):
    df, x, y = vecs(spark, 120, 3)
    model, names, audit = learn.fit_logistic(df, "y", "v", tol=1e-12)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    grad = (p - np.eye(3)[y]).T @ x + w
    assert np.abs(grad).max() < 1e-3 and audit["status"] == "PASS" and names == [0, 1, 2]
    assert learn.fit_logistic(df, "y", "v", max_iter=1)[2]["status"] == "FAILED"
    got = learn.predict(model, names, df, "v").orderBy("i").collect()
    assert [r.predicted for r in got] == p.argmax(1).tolist()


def test_vote(spark):
    df = spark.createDataFrame([(1, "a", [0.6, 0.4]), (1, "a", [0.1, 0.9]), (2, "b", [0.5, 0.5])], "t bigint, y string, probabilities array<double>")
    assert {r.t: r.predicted for r in learn.vote(df, ["t"], "y", ["a", "b"]).collect()} == {1: "b", 2: "a"}


def test_nearest_mean(spark):
    df, x, y = vecs(spark)
    means = np.stack([x[y == k].mean(0) for k in range(3)])
    want = np.linalg.norm(x[:, None] - means[None], axis=2).argmin(1)
    assert [r.predicted for r in learn.nearest_mean(df, df, "y", "v", ["i"]).orderBy("i").collect()] == want.tolist()


# --- protocol

def trial_rows(spark):
    rows = [(s, "0train", str((t - 1) % 6), t, f"S{s:02d}_0train_T{t:03d}", "ab"[t % 2]) for s in (1, 2, 3) for t in range(1, 25)]
    return spark.createDataFrame(rows, "subject bigint, session string, run string, trial_id bigint, trial_uid string, class_label string")


def test_identity_audit(spark):
    t = trial_rows(spark)
    a = protocol.identity_audit(t).collect()
    assert len(a) == 3 * 3 * 5 and all(r.relation_pass for r in a)
    t2 = [r for r in a if r.protocol == "T2" and r.role == "target_center_fit"]
    assert {(r.n_trials, r.overlap_n) for r in t2} == {(12, 0)} and {r.overlap_n for r in a if r.protocol == "T1" and r.role == "target_center_fit"} == {24}
    flipped = protocol.identity_audit(t.withColumn("class_label", F.lit("z"))).collect()
    assert sorted(map(str, a)) == sorted(map(str, flipped))  # labels change nothing
    halves = protocol.calibration_halves(t)
    assert halves.groupBy("trial_uid").agg(F.countDistinct("part").alias("n")).where("n <> 2").count() == 0


def test_leakage_centers_brute(spark):
    df, x, y = vecs(spark, 40, 2)
    df = df.withColumn("fold", F.col("i") % 4)
    got = {(r.condition, r.fold, r.y): r for r in protocol.leakage_centers(df, "y", "fold", "v", 4).collect()}
    i = np.arange(40)
    for f in range(4):
        for k in range(3):
            assert np.allclose(got["fold_safe", f, k].center, x[(y == k) & (i % 4 != f)].mean(0)) and np.allclose(got["v1_all_sample", f, k].center, x[y == k].mean(0))


def test_loso(spark):
    rows = []
    for s in (1, 2):
        for t in range(24):
            y = t % 2
            rows.append((s, str(t % 6), f"{s}-{t}", "ab"[y], [float(5 * s + 3 * y + RNG.normal() * 0.2), float(RNG.normal())]))
    df = spark.createDataFrame(rows, "subject bigint, run string, trial_uid string, class_label string, coords array<double>")
    got = {(r.target, r.geometry, r.split): r for r in protocol.loso(df.coalesce(1), "class_label", max_iter=30).collect()}
    assert len(got) == 2 * 2 * 4
    assert all(r.balanced_accuracy == 1.0 for k, r in got.items() if k[1] == "LE" and k[2] == "ALL")
    assert {r.transductive_overlap for r in got.values()} == {"True", "False", "not_applicable"}
    assert got[1, "LE", "AGGREGATE"].n == 24
    failed = protocol.loso(df.coalesce(1), "class_label", max_iter=1).collect()
    assert {r.status for r in failed} == {"FAILED"} and all(r.accuracy is None for r in failed)


# --- gates, verdicts, contracts

def test_gate(spark):
    df, _ = covs(spark)
    df = df.withColumn("trial_uid", F.concat_ws("-", "g", F.sha2(F.array_join("cov", ","), 256)))
    rows = gates.gate_rows(gates.evaluate_scopes(df, ["g"]), ["g"]).persist()
    p = gates.gate_payload(rows).first()
    assert (p.rows_total, p.rows_required, p.rows_failed, p.classification_allowed) == (48, 45, 0, True)
    gates.require_gate(json.dumps(p.asDict()), rows)
    for wrong in ({"classification_allowed": 1}, {"rows_total": 47}):
        with pytest.raises(gates.GateError):
            gates.require_gate(json.dumps(p.asDict() | wrong), rows)
    bad = df.unionByName(df.limit(1).withColumn("cov", F.transform("cov", lambda x: -x)))
    assert not gates.gate_payload(gates.gate_rows(gates.evaluate_scopes(bad, ["g"]), ["g"])).first().classification_allowed
    assert not gates.gate_payload(rows.limit(0)).first().classification_allowed


def pivot(spark, le, airm, raw=0.3):
    return spark.createDataFrame([(s, raw, raw + le(s), raw + airm(s), raw) for s in range(1, 10)], "subject bigint, RAW double, LE double, AIRM double, EA double")


def test_questions(spark):
    say = lambda a, b, n=0: tuple(r.verdict for r in verdicts.questions(a, b, n).orderBy("question").collect())
    good = pivot(spark, lambda s: 0.05, lambda s: 0.05)
    assert say(good, good) == ("ROBUSTLY SUPPORTED", "NOT SUPPORTED", "SMALL IN THIS PILOT")
    assert say(pivot(spark, lambda s: 0.05, lambda s: -0.01), good)[:2] == ("GEOMETRY-SENSITIVE-MIXED", "SUPPORTED")
    assert say(good, pivot(spark, lambda s: 0.1, lambda s: 0.05))[2] == "POTENTIALLY IMPORTANT"
    assert say(pivot(spark, lambda s: 0.0, lambda s: 0.0), good)[0] == "NOT SUPPORTED"
    assert set(say(good, good, 4)) == {"UNASSESSED — TECHNICAL FAILURE"}


def test_hypotheses(spark):
    rows = [("H1", "x", 0.02, 0.02, True), ("H1", "x", 0.05, 0.02, True), ("H2", "whole", 1.0, 0.02, False), ("H2", "whole", 1.0, 0.02, False), ("H2", "window", 1.0, 0.02, False), ("H4", "x", 0.0, 0.02, False), ("H5", "x", 0.02, 0.02, False), ("H6", "x", 0.0, 0.01, False), ("H6", "x", 0.01, 0.01, False)]
    df = spark.createDataFrame(rows, "hypothesis string, part string, value double, threshold double, both_ways boolean")
    h = verdicts.hypotheses(df)
    assert {r.hypothesis: r.verdict for r in h.collect()} == {"H1": "SUPPORTED", "H2": "MIXED", "H4": "NOT SUPPORTED", "H5": "SUPPORTED", "H6": "MIXED"}
    assert tuple(verdicts.distinctions(h).first()) == ("SUPPORTED", "MIXED", "NOT SUPPORTED")


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, None, 1), (2, "b", 2)], "k bigint, v string, w bigint")
    assert contracts.duplicates(df, ["k"]).count() == 2 and contracts.duplicates(df, ["k", "w"]).count() == 0
    assert [r.k for r in contracts.functional_violations(df, ["k"], "v").collect()] == [2]
    assert contracts.incomplete_windows(df, ["k"], 2, "w").count() == 0 and contracts.incomplete_windows(df, ["k"], 3, "w").count() == 2
    with pytest.raises(contracts.ContractError):
        contracts.require_empty(contracts.duplicates(df, ["k"]), "k repeats")
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["nope"])
    rows = spark.createDataFrame([("PASS", 0.5), ("FAILED", None), ("FAILED", 0.1), ("PASS", 1.5)], "status string, accuracy double")
    got = {r.check_name: r.violations for r in contracts.checks(rows, contracts.status_rules(["accuracy"])).collect()}
    assert got == {"status_known": 0, "accuracy_null_iff_failed": 1, "accuracy_in_range": 1}
    assert {r.check_name: r.passed for r in contracts.constant_columns(df, ["k"]).collect()} == {"k_constant": False}
    agg = spark.createDataFrame([(1, "A", 0.4), (1, "B", 0.6), (1, "AGGREGATE", 0.5)], "subject bigint, split string, balanced_accuracy double")
    assert verdicts.aggregate_identity(agg, ["subject"]).count() == 0


# --- sources, sinks, report

def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sample_index,subject,session,run,trial_id,run_trial_id,trial_uid,class_label\n0,1,0train,0,1,1,S01,a\n")
    assert readers.csv(spark, f"file://{tmp_path}/t.csv").first().run == "0"
    sinks.json_file(tmp_path / "a.json", {"b": 1, "a": "é"})
    assert readers.json_object(spark, f"file://{tmp_path}/a.json").first().a == "é"
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        readers.json_object(spark, f"file://{tmp_path}/l.json")
    sinks.freeze(tmp_path / "f", b"x")
    sinks.freeze(tmp_path / "f", b"x")
    with pytest.raises(FileExistsError):
        sinks.freeze(tmp_path / "f", b"y")
    with pytest.raises(ValueError):
        sinks.inside(tmp_path, "../x")
    (tmp_path / "c.yaml").write_text("data: {n: 5}\n")
    assert config.load(tmp_path / "c.yaml", ("data",), {"data.n": 5}) == {"data": {"n": 5}}
    for bad in ({"data.n": 6}, {"data.n": 5.0}):
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "c.yaml", (), bad)
    e = spark.createDataFrame([("u", 1, 2, [[1.0, float("nan")]])], readers.EPOCHS)
    sinks.parquet(e, f"file://{tmp_path}/e")
    with pytest.raises(Exception, match="bad signal"):
        readers.epochs(spark, f"file://{tmp_path}/e").collect()


def test_fixity(spark, tmp_path):
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    h = fixity.fingerprint(df)
    assert h == fixity.fingerprint(df.orderBy(F.desc("id")).select("v", "id")) != fixity.fingerprint(df.union(df.limit(1)))
    assert fixity.reuse_or_recompute(lambda: df, h, lambda: df, f"file://{tmp_path}/c")[1]
    again, reused = fixity.reuse_or_recompute(lambda: df.limit(3), h, lambda: df, f"file://{tmp_path}/c")
    assert not reused and again.count() == 20
    with pytest.raises(fixity.DataContractError):
        fixity.pinned(df, "0")


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("whole", "raw", "class silhouette", "0.1"), ("WINDOW5", "centered", "subject distance ratio", "x")], "representation string, state string, metric string, value string")
    assert sorted(map(tuple, report.separability_scores(df).collect()), key=str) == [("whole_raw", "class_silhouette", "all", 0.1), ("window5_centered", "subject_separation_ratio", "all", None)]
    text = report.render("T", dict.fromkeys(report.SECTIONS, "x"))
    assert text.count("\n## ") == 14
    with pytest.raises(contracts.ContractError):
        report.render("T", {"Motivation": "x"})
    assert report.markdown(spark.range(1)).splitlines()[-1] == "| 0 |"


def test_stages_end_to_end(spark, tmp_path):
    from covarium.plans import stages

    rows = []
    for s in (1, 2):
        for t in range(1, 25):
            x = RNG.normal(size=(3, 50)) * np.array([[1 + t % 2], [1.0], [s]])
            rows.append((s, "0train", str((t - 1) % 6), t, f"S{s:02d}_0train_T{t:03d}", "ab"[t % 2], x.tolist()))
    spark.createDataFrame(rows, "subject bigint, session string, run string, trial_id bigint, trial_uid string, class_label string, signal array<array<double>>").write.parquet(f"{tmp_path}/in/trials")
    for name in ("prepare", "covariances", "coordinates", "diagnostics", "gate", "loso", "report"):
        stages.STAGES[name](spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert "Frozen decision-rule verdicts" in (tmp_path / "out/report.md").read_text()
    for name in ("figure_1_loso_ba_by_subject", "figure_2_paired_delta_vs_raw", "geometry_summary"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/out/{name}").count() >= 2
    assert spark.read.parquet(f"{tmp_path}/out/loso").count() == 2 * 2 * 4
