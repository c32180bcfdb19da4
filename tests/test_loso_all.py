"""The LOSO runner gives rows for all geometries and all MDM decoders, and the report holds them."""

import numpy as np

from covarium.operators import centers, learn, protocol


def test_all_geometries_and_mdm(spark):
    rng, rows = np.random.default_rng(3), []
    for s in (1, 2, 3):
        for t in range(24):
            y = t % 2
            x = rng.normal(size=(2, 60)) * np.array([[s * (1 + 2 * y)], [s]])
            rows.append((s, str(t // 2 % 6), f"{s}-{t}", "ab"[y], (x @ x.T / 60).ravel().tolist()))
    df = centers.with_log(spark.createDataFrame(rows, "subject bigint, run string, trial_uid string, class_label string, cov array<double>").coalesce(1))
    got = {(r.target, r.geometry, r.split): r for r in protocol.loso(df, "class_label", geometries=protocol.GEOMETRIES).collect()}
    assert len(got) == 3 * 4 * 4 and {r.status for r in got.values()} == {"PASS"}
    assert all(r.balanced_accuracy > 0.9 for k, r in got.items() if k[1] != "RAW")
    mdm = {(r.target, r.geometry, r.metric, r.split): r for r in protocol.loso_mdm(df, "class_label").collect()}
    assert len(mdm) == 3 * 5 * 4 and {k[1:3] for k in mdm} == set(protocol.MDM_SPECS)
    assert all(r.balanced_accuracy > 0.9 for k, r in mdm.items() if k[1] != "RAW")
    assert mdm[1, "AIRM", "riemann", "AGGREGATE"].n == 24


def test_all_models_in_common_passes(spark):
    """The models equal those fitted one by one, in a number of jobs that doesn't grow with the number of subjects."""
    rng, rows = np.random.default_rng(4), []
    for i in range(360):
        y = i % 3
        rows.append((i % 6 + 1, str(i // 6 % 6), f"t{i}", "abc"[y], (rng.normal(size=4) * [1, 30, 0.1, 1] + [y, 40, 0, 0.3 * (i % 6)]).tolist()))
    df = spark.createDataFrame(rows, "subject bigint, run string, trial_uid string, class_label string, coords array<double>").coalesce(2).persist()
    context = spark.sparkContext
    context.setJobGroup("loso", "loso")
    try:
        got = {(r.target, r.split): r for r in protocol.loso(df, "class_label", geometries=("RAW",)).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("loso"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 6 * 4 and jobs < 80
    for target in (1, 4):
        model, names, audit = learn.fit_logistic(df.where(f"subject <> {target}"), "class_label", "coords", tol=1e-10)
        one = learn.predict(model, names, df.where(f"subject = {target}"), "coords")
        assert got[target, "ALL"].status == audit["status"] == "PASS"
        assert got[target, "ALL"].accuracy == one.where("class_label = predicted").count() / one.count()
