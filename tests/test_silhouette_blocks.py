"""Silhouettes in blocks, and separability over all rows with whole trials in the sample."""

import numpy as np
import pytest

from covarium.operators import stats
from covarium.plans import stages


def windows(spark):
    rng, rows = np.random.default_rng(5), []
    for s in (1, 2):
        for t in range(20):
            for w in range(1, 6):
                rows.append((s, f"{s}-{t}", "ab"[t % 2], w, [float(x) for x in rng.normal(size=3) + [t % 2, s, 0.3 * w]]))
    return spark.createDataFrame(rows, "subject bigint, trial_uid string, class_label string, window_index int, v array<double>")


def test_blocks_equal_one_block(spark, monkeypatch):
    df = windows(spark)
    want = stats.silhouette(df, "class_label", "v").first()
    monkeypatch.setattr(stats, "SILHOUETTE_ROWS", 50)
    monkeypatch.setattr(stats, "SILHOUETTE_BLOCK", 17)
    got = stats.silhouette(df.repartition(3), "class_label", "v").first()
    assert got.n == want.n == 200 and got.silhouette == pytest.approx(want.silhouette, abs=1e-9)


def test_sample_serves_global_silhouettes_only(spark):
    df = windows(spark)
    sample = stages.whole_trials(df, 8)
    assert {r["count"] for r in sample.groupBy("trial_uid").count().collect()} == {5} and sample.count() == 40
    labels = {"class": "class_label", "subject": "subject"}
    whole = {(r.metric, r.window): r.value for r in stats.separability(df, "v", labels, "w", "window_index").collect()}
    part = {(r.metric, r.window): r.value for r in stats.separability(df, "v", labels, "w", "window_index", sample).collect()}
    assert ("window_silhouette", "all") in part and ("class_separation_ratio", "3") in part and set(part) == set(whole)
    changed = {k for k in whole if whole[k] != pytest.approx(part[k], abs=1e-9)}
    assert changed == {(f"{x}_silhouette", "all") for x in ("class", "subject", "window")}
