"""Registered queries over the driver tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covarium.functions import spd, vectors
from covarium.functions.digest import set_hashes
from covarium.operators import centers, contracts, covariance, gates, learn, protocol, stats, trials, verdicts
from covarium.plans import bridge
from covarium.sources.readers import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SEED = trials.SEED
CLASSES = ("click", "purchase", "search", "signup", "view")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    """Six digits; no negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _r(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


_TRIALS = """
e AS (SELECT event_id AS sample_index, user_id % 9 + 1 AS subject, '0train' AS session, event_type AS class_label, ts FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts, sample_index) AS trial_id FROM e),
trials AS (SELECT sample_index, subject, session, CAST((trial_id - 1) % 6 AS VARCHAR) AS run, trial_id,
                  (trial_id - 1) // 6 + 1 AS run_trial_id, printf('S%02d_%s_T%03d', subject, session, trial_id) AS trial_uid, class_label FROM n)"""
_SAMPLES = """
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample FROM events),
samples AS (SELECT *, sample // 9 + 1 AS window_index FROM s WHERE sample < 45),
means AS (SELECT user_id, CAST(user_id % 3 AS VARCHAR) AS class_label, window_index, avg(value) AS m FROM samples GROUP BY ALL)"""
_STEPS = _SAMPLES + """,
lagged AS (SELECT *, lag(m) OVER (PARTITION BY user_id ORDER BY window_index) AS b FROM means),
steps AS (SELECT user_id, class_label, concat(window_index - 1, '-', window_index) AS window_pair, m - b AS delta, abs(m - b) AS magnitude FROM lagged WHERE b IS NOT NULL)"""
_COV = """
mo AS (SELECT l_suppkey, l_returnflag, count(*) AS fit_n, covar_pop(l_quantity / 50, l_quantity / 50) AS a, covar_pop(l_quantity / 50, l_extendedprice / 100000) AS b,
              covar_pop(l_extendedprice / 100000, l_extendedprice / 100000) AS d FROM lineitem GROUP BY 1, 2),
mu AS (SELECT *, (a + d) / 2 AS mu, (a * a + 2 * b * b + d * d) / 4 AS al FROM mo),
sh AS (SELECT *, CASE WHEN (fit_n + 1) * (al - mu * mu / 2) = 0 THEN 1.0 ELSE least((al + mu * mu) / ((fit_n + 1) * (al - mu * mu / 2)), 1.0) END AS w FROM mu),
cov AS (SELECT l_suppkey, l_returnflag, l_suppkey % 9 + 1 AS subject, fit_n, CAST(w AS DOUBLE) AS shrinkage, (1 - w) * a + w * mu AS a, (1 - w) * b AS b, (1 - w) * d + w * mu AS d FROM sh),
ev AS (SELECT *, (a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS lo, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS hi FROM cov),
sl AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (ln(hi) - ln(lo)) / (hi - lo) END AS k FROM ev),
lg AS (SELECT *, k * a + ln(lo) - k * lo AS z0, k * b * sqrt(2) AS z1, k * d + ln(lo) - k * lo AS z2 FROM sl)"""
_COORDS = """
x AS (SELECT vec_id, label, vec_id % 9 + 1 AS subject, embedding FROM embeddings),
l AS (SELECT vec_id, label, subject, unnest(range(1, len(embedding) + 1)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM x)"""


# --- identity, windows and contracts

@query(f"WITH {_TRIALS} SELECT * FROM trials")
def q01_trial_identity(spark, d):
    return bridge.trial_table(spark, d)


@query(f"WITH {_TRIALS} SELECT subject, session, run, trial_id, trial_uid FROM trials")
def q02_label_free_view(spark, d):
    return trials.label_free(bridge.trial_table(spark, d))


@query(f"WITH {_TRIALS} SELECT trial_uid, CAST(w AS BIGINT) AS window_index, CAST(sample_index * 5 + w - 1 AS BIGINT) AS covariance_index FROM trials, range(1, 6) t(w)")
def q03_window_replicate(spark, d):
    return trials.replicate_windows(bridge.trial_table(spark, d)).select("trial_uid", "window_index", "covariance_index")


@query(f"WITH {_SAMPLES} SELECT user_id, CAST(window_index AS BIGINT) AS window_index, count(*) AS n, CAST(min(sample) AS BIGINT) AS first_sample, CAST(max(sample) AS BIGINT) AS last_sample FROM samples GROUP BY ALL")
def q04_exact_window_assign(spark, d):
    s = bridge.window_samples(spark, d)
    return s.groupBy("user_id", "window_index").agg(F.count(F.lit(1)).alias("n"), F.min("sample").cast("long").alias("first_sample"), F.max("sample").cast("long").alias("last_sample"))


@query(f"WITH {_TRIALS} SELECT subject, class_label, count(*) AS n, min(trial_id) AS first_trial, max(trial_id) AS last_trial, count(DISTINCT run) AS n_runs FROM trials GROUP BY 1, 2")
def q05_count_contract(spark, d):
    return bridge.trial_table(spark, d).groupBy("subject", "class_label").agg(F.count(F.lit(1)).alias("n"), F.min("trial_id").alias("first_trial"), F.max("trial_id").alias("last_trial"), F.countDistinct("run").alias("n_runs"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q06_uniqueness_violations(spark, d):
    return contracts.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def q07_fd_check(spark, d):
    return contracts.functional_violations(table(spark, d, "events"), ["user_id"], "event_type")


@query(f"""WITH {_SAMPLES}, w AS (SELECT DISTINCT user_id, event_type, window_index FROM samples),
g AS (SELECT user_id, event_type, string_agg(CAST(window_index AS VARCHAR), ',' ORDER BY window_index) AS windows FROM w GROUP BY 1, 2)
SELECT * FROM g WHERE windows <> '1,2,3,4,5'""")
def q08_window_completeness(spark, d):
    seen = bridge.window_samples(spark, d).select("user_id", "event_type", "window_index").distinct()
    return contracts.incomplete_windows(seen, ["user_id", "event_type"]).withColumn("windows", F.array_join(F.col("windows").cast("array<string>"), ","))


@query(f"WITH {_TRIALS} SELECT subject, " + ", ".join(f"count(*) FILTER (class_label = '{c}') AS {c}" for c in CLASSES) + " FROM trials GROUP BY 1")
def q09_class_count_pivot(spark, d):
    return bridge.trial_table(spark, d).groupBy("subject").pivot("class_label", list(CLASSES)).count().na.fill(0)


@query(f"""WITH {_TRIALS}, g AS (SELECT *, sha256('{{"seed":{SEED},"values":[{{"type":"int","value":"' || subject || '"}},{{"type":"str","value":"' || session || '"}},{{"type":"int","value":"' || trial_id || '"}}]}}') AS h FROM trials)
SELECT trial_uid, subject, class_label, CAST((row_number() OVER (PARTITION BY subject, class_label ORDER BY h, trial_id) - 1) % 5 AS BIGINT) AS fold FROM g""")
def q10_digest_folds(spark, d):
    key = [("subject", "int"), ("session", "str"), ("trial_id", "int")]
    return trials.folds(bridge.trial_table(spark, d), 5, SEED, key).select("trial_uid", "subject", "class_label", "fold")


@query(f"""WITH p AS (SELECT a.s_nationkey AS subject, a.s_name AS uid_left, b.s_name AS uid_right,
  sha256('[{SEED},"' || a.s_nationkey || '","' || a.s_name || '","' || b.s_name || '"]') AS digest FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_name < b.s_name),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY digest, uid_left, uid_right) AS rank FROM p) SELECT * FROM r WHERE rank <= 3""")
def q11_topk_pairs(spark, d):
    return trials.pair_top_k(table(spark, d, "supplier"), 3, SEED, "s_nationkey", "s_name")


@query(f"""WITH {_TRIALS}, st AS (SELECT subject, class_label, row_number() OVER (ORDER BY subject, class_label) AS place, count(*) OVER () AS total FROM (SELECT DISTINCT subject, class_label FROM trials)),
r AS (SELECT t.*, place, total, row_number() OVER (PARTITION BY t.subject, t.class_label ORDER BY sha256('{SEED}|silhouette|' || trial_uid), trial_uid) AS rn FROM trials t JOIN st USING (subject, class_label))
SELECT trial_uid, subject, class_label FROM r WHERE rn <= 200 // total + CASE WHEN place <= 200 % total THEN 1 ELSE 0 END""")
def q12_balanced_subset(spark, d):
    return trials.balanced_subset(bridge.trial_table(spark, d), 200).select("trial_uid", "subject", "class_label")


@query(f"""WITH {_TRIALS} SELECT subject, count(*) AS n, sha256('{{"trial_uids":["' || string_agg(trial_uid, '","' ORDER BY trial_uid) || '"]}}') AS trial_uid_sha256 FROM trials GROUP BY 1""")
def q13_uid_set_hash(spark, d):
    return set_hashes(bridge.trial_table(spark, d), ["subject"], "trial_uid").withColumnRenamed("sha256", "trial_uid_sha256")


@query(f"""WITH {_TRIALS}, t AS (SELECT DISTINCT subject AS target FROM trials)
SELECT target, CASE WHEN subject = target THEN 'target' ELSE 'source' END AS role, count(*) AS n, count(DISTINCT subject) AS n_subjects, min(trial_uid) AS first_uid, max(trial_uid) AS last_uid FROM trials, t GROUP BY 1, 2""")
def q14_loso_roles(spark, d):
    r = protocol.loso_roles(bridge.trial_table(spark, d))
    return r.groupBy("target", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_subjects"), F.min("trial_uid").alias("first_uid"), F.max("trial_uid").alias("last_uid"))


@query(f"""WITH {_TRIALS} SELECT subject, split, CASE WHEN (split = 'A') = (run IN ('0', '1', '2')) THEN 'calibration' ELSE 'evaluation' END AS part, count(*) AS n, count(DISTINCT run) AS n_runs
FROM trials, (VALUES ('A'), ('B')) s(split) GROUP BY 1, 2, 3""")
def q15_calibration_halves(spark, d):
    r = protocol.calibration_halves(bridge.trial_table(spark, d))
    return r.groupBy("subject", "split", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run").alias("n_runs"))


_ROLES = _TRIALS + """,
t AS (SELECT DISTINCT subject AS target FROM trials),
p AS (SELECT target, CASE WHEN split = 'ALL' THEN 'T1' ELSE 'T2' END AS protocol, split, trials.*, CASE split WHEN 'A' THEN run IN ('0', '1', '2') WHEN 'B' THEN run IN ('3', '4', '5') END AS half
      FROM trials, t, (VALUES ('ALL'), ('A'), ('B')) s(split)),
roles AS (
  SELECT target, protocol, split, 'source_center_fit' AS role, subject AS fit_subject, trial_uid, subject, run FROM p WHERE subject <> target
  UNION ALL SELECT target, protocol, split, 'classifier_train', NULL, trial_uid, subject, run FROM p WHERE subject <> target
  UNION ALL SELECT target, protocol, split, 'target_center_fit', subject, trial_uid, subject, run FROM p WHERE subject = target AND (protocol = 'T1' OR half)
  UNION ALL SELECT target, protocol, split, 'evaluation', NULL, trial_uid, subject, run FROM p WHERE subject = target AND (protocol = 'T1' OR NOT half)),
ev AS (SELECT DISTINCT target, protocol, split, trial_uid FROM roles WHERE role = 'evaluation'),
au AS (SELECT r.target, r.protocol, r.split, role, fit_subject, count(*) AS n_trials, count(DISTINCT subject) AS n_subjects, string_agg(DISTINCT run, ',' ORDER BY run) AS runs,
         sha256('{"trial_uids":["' || string_agg(r.trial_uid, '","' ORDER BY r.trial_uid) || '"]}') AS trial_uid_sha256, count(ev.trial_uid) AS overlap_n
       FROM roles r LEFT JOIN ev ON r.target = ev.target AND r.protocol = ev.protocol AND r.split = ev.split AND r.trial_uid = ev.trial_uid GROUP BY 1, 2, 3, 4, 5)"""


@query(f"""WITH {_ROLES}, w AS (SELECT *, CASE WHEN role = 'evaluation' THEN 'self' WHEN role = 'target_center_fit' AND protocol = 'T1' THEN 'equal' ELSE 'disjoint' END AS expected_relation,
  CASE WHEN role IN ('source_center_fit', 'target_center_fit') THEN 'forbidden' WHEN role = 'classifier_train' THEN 'source_labels_only' ELSE 'target_labels_only' END AS label_access FROM au)
SELECT *, CASE WHEN expected_relation = 'disjoint' THEN overlap_n = 0 ELSE overlap_n = n_trials END AS relation_pass FROM w""")
def q16_identity_audit(spark, d):
    return protocol.identity_audit(bridge.trial_table(spark, d))


@query(f"""WITH {_TRIALS}, o AS (SELECT DISTINCT subject, class_label FROM trials WHERE subject <> 3),
g AS (SELECT CAST(s AS BIGINT) AS subject, c AS class_label FROM range(1, 10) a(s), (VALUES ('click'), ('purchase'), ('search'), ('view'), ('unseen')) b(c))
SELECT subject, class_label, 'missing' AS issue FROM (SELECT * FROM g EXCEPT SELECT * FROM o) UNION ALL SELECT subject, class_label, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM g)""")
def q17_expected_grid_antijoin(spark, d):
    seen = bridge.trial_table(spark, d).where("subject <> 3").select("subject", "class_label").distinct()
    names = spark.createDataFrame([(c,) for c in (*[c for c in CLASSES if c != "signup"], "unseen")], "class_label string")
    return contracts.grid_difference(seen, [spark.range(1, 10).withColumnRenamed("id", "subject"), names], ["subject", "class_label"])


@query(f"WITH {_TRIALS} SELECT 'WHOLE' AS representation, subject, count(*) AS n, count(DISTINCT class_label) AS n_classes FROM trials GROUP BY 2 UNION ALL SELECT 'WINDOW5', subject, count(*) * 5, count(DISTINCT class_label) FROM trials GROUP BY 2")
def q18_union_reps(spark, d):
    t = bridge.trial_table(spark, d)
    both = t.withColumn("representation", F.lit("WHOLE")).unionByName(trials.replicate_windows(t).withColumn("representation", F.lit("WINDOW5")), allowMissingColumns=True)
    return both.groupBy("representation", "subject").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("class_label").alias("n_classes"))


@query("""WITH a AS (SELECT DISTINCT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k)
SELECT count(x) AS n_a, count(y) AS n_b, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_both, count(*) AS n_union, count(*) FILTER (y IS NULL) AS n_only_a, count(*) FILTER (x IS NULL) AS n_only_b,
  count(*) FILTER (x IS NULL OR y IS NULL) = 0 AS equal, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) = 0 AS disjoint FROM j""")
def q19_set_relations(spark, d):
    return contracts.set_relations(table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"), "k")


# --- transitions and effect sizes

def _steps(spark, d):
    return stats.transition_steps(bridge.window_means(spark, d), ["user_id"], "window_index", "z")


@query(f"WITH {_STEPS} SELECT user_id, window_pair, {_r('delta')} AS delta, {_r('magnitude')} AS magnitude FROM steps")
def q20_transition_steps(spark, d):
    return _steps(spark, d).select("user_id", "window_pair", r6(F.col("delta")[0]).alias("delta"), r6("magnitude").alias("magnitude"))


@query(f"""WITH {_STEPS} SELECT class_label, coalesce(window_pair, 'all') AS scope, count(*) AS n, {_r('avg(magnitude)')} AS mean, {_r('coalesce(stddev_samp(magnitude), 0)')} AS std, {_r('median(magnitude)')} AS median
FROM steps GROUP BY GROUPING SETS ((class_label), (class_label, window_pair))""")
def q21_transition_summary_sets(spark, d):
    out = stats.descriptive(_steps(spark, d), "class_label", "window_pair", "magnitude")
    return out.select("class_label", "scope", "n", *[r6(c).alias(c) for c in ("mean", "std", "median")])


@query(f"""WITH {_STEPS}, t AS (SELECT user_id, class_label, avg(magnitude) AS m FROM steps GROUP BY 1, 2), g AS (SELECT class_label, avg(m) AS m, count(*) AS n FROM t GROUP BY 1)
SELECT 'pair' AS kind, window_pair AS name, {_r('avg(magnitude)')} AS mean, count(*) AS n FROM steps GROUP BY 2
UNION ALL SELECT 'class', class_label, {_r('m')}, n FROM g UNION ALL SELECT 'range_fraction', 'all', {_r('(max(m) - min(m)) / abs(sum(m * n) / sum(n))')}, CAST(sum(n) AS BIGINT) FROM g""")
def q22_pair_two_level_means(spark, d):
    s = _steps(spark, d)
    groups, spread = stats.two_level_means(s, ["user_id"], "class_label", "magnitude")
    rows = stats.pair_summary(s, "window_pair", "magnitude").select(F.lit("pair").alias("kind"), F.col("window_pair").alias("name"), "mean", "n")
    rows = rows.unionByName(groups.select(F.lit("class").alias("kind"), F.col("class_label").alias("name"), "mean", "n"))
    n = groups.agg(F.sum("n").alias("n"))
    rows = rows.unionByName(spread.crossJoin(n).select(F.lit("range_fraction").alias("kind"), F.lit("all").alias("name"), F.col("range_fraction").alias("mean"), "n"))
    return rows.withColumn("mean", r6("mean"))


@query(f"""WITH {_STEPS}, g AS (SELECT window_pair, class_label, count(*) AS n, avg(magnitude) AS m FROM steps GROUP BY 1, 2), t AS (SELECT window_pair, avg(magnitude) AS gm, var_pop(magnitude) * count(*) AS total, count(*) AS n FROM steps GROUP BY 1)
SELECT t.window_pair, {_r('CASE WHEN max(total) = 0 THEN 0 ELSE sum(g.n * (m - gm) * (m - gm)) / max(total) END')} AS eta_squared, max(t.n) AS n FROM g JOIN t ON g.window_pair = t.window_pair GROUP BY 1""")
def q23_eta_squared(spark, d):
    return stats.eta_squared(_steps(spark, d), "class_label", "magnitude", ["window_pair"]).select("window_pair", r6("eta_squared").alias("eta_squared"), "n")


@query("SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, " + ", ".join(f"{_r(f)} AS {n}" for n, f in (("mean", "avg(l_extendedprice)"), ("std", "stddev_samp(l_extendedprice)"), ("median", "median(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"))) + " FROM lineitem GROUP BY 1, 2")
def q24_six_stats(spark, d):
    out = stats.six_numbers(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "n", *[r6(c).alias(c) for c in ("mean", "std", "median", "min", "max")])


@query(f"WITH {_TRIALS} SELECT subject, class_label, min(trial_id) AS trial_id, arg_min(trial_uid, trial_id) AS trial_uid FROM trials GROUP BY 1, 2")
def q25_first_by_min_key(spark, d):
    return trials.first_by(bridge.trial_table(spark, d), ["subject", "class_label"], "trial_id", "trial_uid")


# --- covariances of two channels, in closed form

def _logs(spark, d):
    c = bridge.covariances(spark, d)
    return c.withColumn("log", vectors.function2(F.col("cov")[0], F.col("cov")[1], F.col("cov")[3], F.log)).withColumn("coords", vectors.svec(F.col("log"), 2))


@query(f"WITH {_COV} SELECT l_suppkey, l_returnflag, fit_n, {_r('shrinkage')} AS shrinkage, {_r('a')} AS c00, {_r('b')} AS c01, {_r('d')} AS c11 FROM cov")
def q26_cov2_oas(spark, d):
    c = bridge.covariances(spark, d)
    return c.select("l_suppkey", "l_returnflag", "fit_n", r6("shrinkage").alias("shrinkage"), *[r6(F.col("cov")[i]).alias(n) for i, n in ((0, "c00"), (1, "c01"), (3, "c11"))])


@query(f"WITH {_COV} SELECT l_suppkey, l_returnflag, {_r('z0')} AS z0, {_r('z1')} AS z1, {_r('z2')} AS z2 FROM lg")
def q27_cov2_log_svec(spark, d):
    return _logs(spark, d).select("l_suppkey", "l_returnflag", *[r6(F.col("coords")[i]).alias(f"z{i}") for i in range(3)])


@query(f"WITH {_COV} SELECT l_suppkey, l_returnflag, " + ", ".join(_r(f"z{i} - avg(z{i}) OVER (PARTITION BY l_suppkey)") + f" AS z{i}" for i in range(3)) + " FROM lg")
def q28_cov2_centered(spark, d):
    out = centers.center_coordinates(_logs(spark, d), ["l_suppkey"])
    return out.select("l_suppkey", "l_returnflag", *[r6(F.col("centered")[i]).alias(f"z{i}") for i in range(3)])


@query(f"WITH {_COV} SELECT l_returnflag, count(*) AS n, count(*) FILTER (lo > 0) AS n_spd, {_r('min(lo)')} AS min_eigenvalue, {_r('max(hi)')} AS max_eigenvalue, {_r('max(hi / lo)')} AS max_condition FROM ev GROUP BY 1")
def q29_cov2_sanity(spark, d):
    c = bridge.covariances(spark, d)
    lo, hi = vectors.eigenvalues2(F.col("cov")[0], F.col("cov")[1], F.col("cov")[3])
    c = c.select("l_returnflag", lo.alias("lo"), hi.alias("hi"))
    cond = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(float("inf"))
    return c.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lo") > 0).alias("n_spd"), r6(F.min("lo")).alias("min_eigenvalue"), r6(F.max("hi")).alias("max_eigenvalue"), r6(F.max(cond)).alias("max_condition"))


def _pairs(df, value):
    a = df.where("l_returnflag = 'A'").select("l_suppkey", F.col(value).alias("x"))
    return a.join(df.where("l_returnflag = 'R'").select("l_suppkey", F.col(value).alias("y")), "l_suppkey")


@query(f"WITH {_COV} SELECT a.l_suppkey, {_r('sqrt((a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2))')} AS distance FROM lg a JOIN lg b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
def q30_cov2_le_distance(spark, d):
    return _pairs(_logs(spark, d), "coords").select("l_suppkey", r6(vectors.distance(F.col("x"), F.col("y"))).alias("distance"))


@query(f"""WITH {_COV}, p AS (SELECT a.l_suppkey, (a.d * b.a - 2 * a.b * b.b + a.a * b.d) / (a.a * a.d - a.b * a.b) AS tr, (b.a * b.d - b.b * b.b) / (a.a * a.d - a.b * a.b) AS de
  FROM cov a JOIN cov b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R'), r AS (SELECT *, sqrt(greatest(tr * tr / 4 - de, 0)) AS g FROM p)
SELECT l_suppkey, {_r('sqrt(ln(tr / 2 - g) * ln(tr / 2 - g) + ln(tr / 2 + g) * ln(tr / 2 + g))')} AS distance FROM r""")
def q31_cov2_airm_distance(spark, d):
    return _pairs(bridge.covariances(spark, d), "cov").select("l_suppkey", r6(spd.airm_distance("x", "y")).alias("distance"))


@query(f"""WITH {_COV}, m AS (SELECT l_suppkey, avg(a) AS a, avg(b) AS b, avg(d) AS d FROM cov GROUP BY 1), q AS (SELECT *, sqrt(a * d - b * b) AS s FROM m), t AS (SELECT *, sqrt(a + d + 2 * s) AS t FROM q)
SELECT l_suppkey, {_r('(d + s) / (s * t)')} AS w00, {_r('-b / (s * t)')} AS w01, {_r('(a + s) / (s * t)')} AS w11, {_r('1')} AS i00, {_r('0')} AS i01, {_r('1')} AS i11 FROM t""")
def q32_cov2_ea_mean_whiten(spark, d):
    m = centers.arithmetic_centers(bridge.covariances(spark, d), ["l_suppkey"])
    w = vectors.function2(F.col("mean")[0], F.col("mean")[1], F.col("mean")[3], lambda x: 1 / F.sqrt(x))
    m = m.withColumn("w", w).select("l_suppkey", "mean", *[F.col("w")[k].alias(f"w{i}") for k, i in ((0, "00"), (1, "01"), (3, "11"))])
    a, b, e = F.col("w00"), F.col("w01"), F.col("w11")
    x, y, z = F.col("mean")[0], F.col("mean")[1], F.col("mean")[3]
    one = {"i00": a * a * x + 2 * a * b * y + b * b * z, "i01": a * b * x + (a * e + b * b) * y + b * e * z, "i11": b * b * x + 2 * b * e * y + e * e * z}
    return m.select("l_suppkey", *[r6(c).alias(c) for c in ("w00", "w01", "w11")], *[r6(c).alias(n) for n, c in one.items()])


# --- coordinates

@query(f"""WITH {_COORDS}, m AS (SELECT subject, pos, avg(v) AS m FROM l GROUP BY 1, 2)
SELECT vec_id, l.subject, {_r('max(v - m) FILTER (l.pos = 1)')} AS c0, {_r('sqrt(sum((v - m) * (v - m)))')} AS norm FROM l JOIN m ON l.subject = m.subject AND l.pos = m.pos GROUP BY 1, 2""")
def q33_coord_centering(spark, d):
    out = centers.center_coordinates(bridge.coordinates(spark, d), ["subject"])
    return out.select("vec_id", "subject", r6(F.col("centered")[0]).alias("c0"), r6(vectors.norm(F.col("centered"))).alias("norm"))


@query(f"""WITH {_COORDS}, c AS (SELECT label, pos, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT label, max(n) AS n, sum(q) AS q, sum(s * s) AS ss FROM c GROUP BY 1),
w AS (SELECT sum(n * q - ss) AS ws, sum(n * (n - 1) / 2) AS wn, sum(n) AS n, sum(q) AS q FROM k), t AS (SELECT sum(s * s) AS ss FROM (SELECT pos, sum(s) AS s FROM c GROUP BY 1)),
r AS (SELECT sqrt(ws / wn) AS wi, sqrt((n * q - t.ss - ws) / (n * (n - 1) / 2 - wn)) AS be FROM w, t) SELECT {_r('be')} AS between_rms, {_r('wi')} AS within_rms, {_r('be / wi')} AS ratio FROM r""")
def q34_rms_ratio(spark, d):
    out = stats.rms_distance_ratio(bridge.coordinates(spark, d), "label", "coords")
    return out.select(r6("between").alias("between_rms"), r6("within").alias("within_rms"), r6("ratio").alias("ratio"))


@query(f"""WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT label, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS s FROM x a, x b GROUP BY 1, 2, 3),
m AS (SELECT p.vec_id, max(CASE WHEN p.label = other THEN s / greatest(n.n - 1, 1) END) AS a, min(CASE WHEN p.label <> other THEN s / n.n END) AS b, max(CASE WHEN p.label = other THEN n.n END) AS own FROM p JOIN n ON n.label = p.other GROUP BY 1)
SELECT {_r('avg(CASE WHEN own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END)')} AS silhouette, count(*) AS n FROM m""")
def q35_silhouette(spark, d):
    return stats.silhouette(bridge.coordinates(spark, d), "label", "coords").select(r6("silhouette").alias("silhouette"), "n")


@query(f"""WITH {_COORDS}, m AS (SELECT label, pos, avg(v) AS m FROM l GROUP BY 1, 2)
SELECT 'all' AS scope, a.label AS class_a, b.label AS class_b, {_r('sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m)))')} AS cosine FROM m a JOIN m b ON a.pos = b.pos AND a.label < b.label GROUP BY 2, 3""")
def q36_class_mean_cosine(spark, d):
    c = bridge.coordinates(spark, d).withColumn("pair", F.lit("1-2"))
    return stats.class_cosines(c, "label", "pair", "coords").where("scope = 'all'").withColumn("cosine", r6("cosine"))


_NEAREST = _COORDS + """,
m AS (SELECT label AS k, pos, avg(v) AS m FROM l WHERE vec_id % 5 <> 0 GROUP BY 1, 2),
dd AS (SELECT vec_id, label AS truth, k, sqrt(sum((v - m) * (v - m))) AS d FROM l JOIN m USING (pos) WHERE vec_id % 5 = 0 GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS rn FROM dd),
pred AS (SELECT vec_id, truth, k AS predicted, d FROM b WHERE rn = 1)"""


def _nearest(spark, d):
    c = bridge.coordinates(spark, d)
    return learn.nearest_mean(c.where("vec_id % 5 <> 0"), c.where("vec_id % 5 = 0"), "label", "coords", ["vec_id"])


@query(f"WITH {_NEAREST} SELECT vec_id, truth, predicted, {_r('d')} AS distance FROM pred")
def q37_nearest_mean_mdm_le(spark, d):
    return _nearest(spark, d).withColumn("distance", r6("distance"))


def _metrics_sql(pairs: str) -> str:
    return f"""{pairs}, ks AS (SELECT source, truth AS k FROM pr UNION SELECT source, predicted FROM pr),
per AS (SELECT ks.source, k, count(*) FILTER (truth = k) AS sup, count(*) FILTER (predicted = k) AS cl, count(*) FILTER (truth = k AND predicted = k) AS hit FROM ks JOIN pr ON ks.source = pr.source GROUP BY 1, 2)
SELECT source, CAST(sum(sup) AS BIGINT) AS n, {_r('sum(hit) / sum(sup)')} AS accuracy, {_r('avg(CASE WHEN sup > 0 THEN hit / sup END)')} AS balanced_accuracy, {_r('avg(CASE WHEN sup + cl > 0 THEN 2 * hit / (sup + cl) ELSE 0 END)')} AS macro_f1 FROM per GROUP BY 1"""


@query(_metrics_sql(f"""WITH {_NEAREST}, pr AS (SELECT 'embeddings' AS source, CAST(truth AS VARCHAR) AS truth, CAST(predicted AS VARCHAR) AS predicted FROM pred
UNION ALL SELECT 'labels', CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR) FROM labels)"""))
def q38_confusion_metrics(spark, d):
    out = None
    pairs = {"embeddings": _nearest(spark, d).select("truth", "predicted"), "labels": table(spark, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted"))}
    for name, p in pairs.items():
        names = sorted(str(r[0]) for r in p.select(F.explode(F.array("truth", "predicted")).alias("k")).distinct().collect())  # classes
        m = learn.metrics(learn.confusion(p, "truth", "predicted", names))
        m = m.select(F.lit(name).alias("source"), "n", *[r6(c).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])
        out = m if out is None else out.unionByName(m)
    return out


@query(f"""WITH {_SAMPLES}, sh AS (SELECT user_id, window_index, {', '.join(f"count(*) FILTER (event_type = '{c}') / count(*) AS p{i}" for i, c in enumerate(CLASSES))} FROM samples GROUP BY 1, 2),
av AS (SELECT user_id, count(*) AS n_windows, {', '.join(f'round(avg(p{i}), 9) AS p{i}' for i in range(len(CLASSES)))} FROM sh GROUP BY 1)
SELECT user_id, n_windows, CASE {' '.join(f"WHEN p{i} = greatest({', '.join(f'p{j}' for j in range(len(CLASSES)))}) THEN '{c}'" for i, c in enumerate(CLASSES))} END AS predicted FROM av""")
def q39_mean_prob_vote(spark, d):
    share = [(F.count_if(F.col("event_type") == c) / F.count(F.lit(1))) for c in CLASSES]
    s = bridge.window_samples(spark, d).groupBy("user_id", "window_index").agg(F.array(*share).alias("p"), F.lit("").alias("truth"))
    means = [F.round(F.avg(F.get("p", F.lit(i))), 9) for i in range(len(CLASSES))]
    v = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_windows"), F.array(*means).alias("probabilities"))
    place = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return v.select("user_id", "n_windows", F.get(F.array(*map(F.lit, CLASSES)), place.cast("int")).alias("predicted"))


@query(f"""WITH {_COORDS}, f AS (SELECT *, vec_id % 5 AS fold FROM l), cs AS (SELECT condition, CAST(fd AS BIGINT) AS fold FROM (VALUES ('v1_all_sample'), ('fold_safe')) c(condition), range(5) r(fd))
SELECT condition, cs.fold, f.subject, {_r('avg(v) FILTER (pos = 1)')} AS c0, {_r('avg(v) FILTER (pos = 2)')} AS c1, count(*) FILTER (pos = 1) AS fit_n FROM cs JOIN f ON condition = 'v1_all_sample' OR f.fold <> cs.fold GROUP BY 1, 2, 3""")
def q40_leakage_centers(spark, d):
    c = bridge.coordinates(spark, d).withColumn("fold", F.col("vec_id") % 5)
    out = protocol.leakage_centers(c, "subject", "fold", "coords", 5)
    return out.select("condition", "fold", "subject", r6(F.col("center")[0]).alias("c0"), r6(F.col("center")[1]).alias("c1"), "fit_n")


# --- verdicts, tokens, JSON, gates

_BA = """
g AS (SELECT c_nationkey % 9 + 1 AS subject, CASE c_mktsegment WHEN 'BUILDING' THEN 'RAW' WHEN 'AUTOMOBILE' THEN 'LE' WHEN 'MACHINERY' THEN 'AIRM' WHEN 'HOUSEHOLD' THEN 'EA' END AS geometry, o_totalprice / 500000 AS v, o_orderstatus
      FROM customer JOIN orders ON c_custkey = o_custkey),
t1 AS (SELECT subject, {0} FROM g GROUP BY 1), t2 AS (SELECT subject, {0} FROM g WHERE o_orderstatus = 'O' GROUP BY 1)""".format(", ".join(f"round(avg(v) FILTER (geometry = '{x}'), 9) AS {x}" for x in ("RAW", "LE", "AIRM", "EA")))


def _ba(spark, d):
    geometry = F.when(F.col("c_mktsegment") == "BUILDING", "RAW").when(F.col("c_mktsegment") == "AUTOMOBILE", "LE").when(F.col("c_mktsegment") == "MACHINERY", "AIRM").when(F.col("c_mktsegment") == "HOUSEHOLD", "EA")
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 9 + 1).alias("subject"), geometry.alias("geometry"))
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 500000).alias("v"), "o_orderstatus")
    g = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rows = lambda x, split: x.groupBy("subject", "geometry").agg(F.round(F.avg("v"), 9).alias("balanced_accuracy")).withColumn("split", F.lit(split))
    return verdicts.ba_pivot(rows(g, "ALL"), "ALL"), verdicts.ba_pivot(rows(g.where("o_orderstatus = 'O'"), "AGGREGATE"), "AGGREGATE")


@query(f"WITH {_BA} SELECT subject, " + ", ".join(f"{_r(f'{x} - RAW')} AS delta_{x}, CASE WHEN {x} - RAW IS NULL THEN 'unassessed_technical_failure' WHEN {x} - RAW > 1e-12 THEN 'improved' WHEN {x} - RAW < -1e-12 THEN 'worsened' ELSE 'tied' END AS category_{x}" for x in ("LE", "AIRM", "EA")) + " FROM t1")
def q41_sign_category(spark, d):
    out = verdicts.subject_deltas(_ba(spark, d)[0])
    return out.select("subject", *[x for g in ("LE", "AIRM", "EA") for x in (r6(f"delta_{g}").alias(f"delta_{g}"), f"category_{g}")])


@query(f"""WITH {_BA}, c AS (SELECT subject, LE - RAW AS dl, AIRM - RAW AS da, CASE WHEN LE - RAW > 1e-12 THEN 1 WHEN LE - RAW < -1e-12 THEN -1 ELSE 0 END AS cl, CASE WHEN AIRM - RAW > 1e-12 THEN 1 WHEN AIRM - RAW < -1e-12 THEN -1 ELSE 0 END AS ca FROM t1),
a AS (SELECT avg(dl) AS l, avg(da) AS m, count(*) FILTER (cl = 1) AS ln, count(*) FILTER (ca = 1) AS mn, count(*) FILTER (cl <> ca) AS odd FROM c), u AS (SELECT avg(LE) AS l1, avg(AIRM) AS m1 FROM t1), w AS (SELECT avg(LE) AS l2, avg(AIRM) AS m2 FROM t2)
SELECT 'Q1' AS question, CASE CAST(l >= 0.01 AND ln >= 6 AS INT) + CAST(m >= 0.01 AND mn >= 6 AS INT) WHEN 2 THEN 'ROBUSTLY SUPPORTED' WHEN 1 THEN 'GEOMETRY-SENSITIVE-MIXED' ELSE 'NOT SUPPORTED' END AS verdict FROM a
UNION ALL SELECT 'Q2', CASE WHEN abs(l - m) >= 0.02 OR (l > 1e-12 AND m < -1e-12) OR (l < -1e-12 AND m > 1e-12) OR odd >= 4 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END FROM a
UNION ALL SELECT 'Q3', CASE WHEN abs(l1 - l2) >= 0.02 OR abs(m1 - m2) >= 0.02 THEN 'POTENTIALLY IMPORTANT' ELSE 'SMALL IN THIS PILOT' END FROM u, w""")
def q41_question_verdicts(spark, d):
    return verdicts.questions(*_ba(spark, d))


@query("""WITH v AS (SELECT DISTINCT 'priority' AS kind, o_orderpriority AS raw FROM orders UNION SELECT DISTINCT 'event', event_type FROM events UNION SELECT DISTINCT 'type', p_type FROM part)
SELECT kind, raw, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS token FROM v""")
def q42_token_normalise(spark, d):
    named = lambda t, c, k: table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("raw")).distinct()
    v = named("orders", "o_orderpriority", "priority").unionByName(named("events", "event_type", "event")).unionByName(named("part", "p_type", "type"))
    return v.withColumn("token", trials.token(F.col("raw")))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY 1")
def q43_json_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))


@query("""WITH g AS (SELECT l_suppkey, l_linenumber, CASE WHEN count(*) % 7 = 0 THEN 'FAILED' ELSE 'PASS' END AS status, CASE WHEN count(*) % 7 <> 0 THEN avg(l_discount) * 10 END AS accuracy, CASE WHEN count(*) % 14 <> 0 THEN avg(l_tax) END AS macro_f1 FROM lineitem GROUP BY 1, 2)
SELECT 'status_known' AS check_name, count(*) FILTER (status NOT IN ('PASS', 'FAILED')) AS violations, count(*) FILTER (status NOT IN ('PASS', 'FAILED')) = 0 AS passed FROM g """ + "".join(f"""
UNION ALL SELECT '{m}_null_iff_failed', count(*) FILTER (({m} IS NULL) <> (status = 'FAILED')), count(*) FILTER (({m} IS NULL) <> (status = 'FAILED')) = 0 FROM g
UNION ALL SELECT '{m}_in_range', count(*) FILTER ({m} NOT BETWEEN 0 AND 1), count(*) FILTER ({m} NOT BETWEEN 0 AND 1) = 0 FROM g""" for m in ("accuracy", "macro_f1")))
def q44_status_null_contract(spark, d):
    n = F.count(F.lit(1))
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.when(n % 7 == 0, "FAILED").otherwise("PASS").alias("status"), F.when(n % 7 != 0, F.avg("l_discount") * 10).alias("accuracy"), F.when(n % 14 != 0, F.avg("l_tax")).alias("macro_f1"))
    return contracts.checks(g, contracts.status_rules(["accuracy", "macro_f1"]))


@query(f"""WITH {_COV}, v AS (SELECT subject, 'nonfinite_count' AS statistic, CAST(0 AS DOUBLE) AS value, TRUE AS required, TRUE AS passed FROM ev GROUP BY 1
UNION ALL SELECT subject, 'non_spd_count', CAST(count(*) FILTER (lo <= 0) AS DOUBLE), TRUE, count(*) FILTER (lo <= 0) = 0 FROM ev GROUP BY 1 UNION ALL SELECT subject, 'minimum_eigenvalue', min(lo), TRUE, min(lo) > 0 FROM ev GROUP BY 1
UNION ALL SELECT subject, 'maximum_condition_number', max(hi / lo), TRUE, max(hi / lo) <= 1e12 FROM ev GROUP BY 1)
SELECT count(*) AS rows_total, count(*) FILTER (required) AS rows_required, count(*) FILTER (required AND NOT passed) AS rows_failed, count(*) FILTER (required) > 0 AND count(*) FILTER (required AND NOT passed) = 0 AS classification_allowed FROM v""")
def q45_gate_rollup(spark, d):
    c = bridge.covariances(spark, d)
    lo, hi = vectors.eigenvalues2(F.col("cov")[0], F.col("cov")[1], F.col("cov")[3])
    finite = F.forall("cov", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    g = c.select("subject", finite.alias("finite"), lo.alias("lo"), hi.alias("hi")).groupBy("subject").agg(
        F.count_if(~F.col("finite")).cast("double").alias("nonfinite_count"), F.count_if(F.col("lo") <= 0).cast("double").alias("non_spd_count"), F.min("lo").alias("minimum_eigenvalue"),
        F.max(F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).otherwise(float("inf"))).alias("maximum_condition_number"))
    values = g.unpivot(["subject"], ["nonfinite_count", "non_spd_count", "minimum_eigenvalue", "maximum_condition_number"], "statistic", "value")
    return gates.gate_payload(gates.gate_rows(values, ["subject"]))


# --- eigendecompositions, fits and end-to-end evaluations

def _cov4(spark, d):
    return bridge.covariances(spark, d, 4)


@query()
def r46_cov4_log_svec(spark, d):
    return _cov4(spark, d).select("l_suppkey", "l_returnflag", F.transform(spd.log_svec("cov"), lambda x: r6(x)).alias("coords"))


@query()
def r47_spd_exp_invsqrt_roundtrip(spark, d):
    """Errors of exp(log C) and of the inverse root's whitening: all about 1e-12 or less."""
    c = _cov4(spark, d)
    back = vectors.distance(spd.symmetric_exp(spd.spd_log("cov")), F.col("cov"))
    eye = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    white = vectors.distance(spd.congruence(spd.spd_invsqrt("cov"), "cov"), eye)
    return c.select("l_suppkey", "l_returnflag", (back < 1e-10).alias("roundtrip_ok"), (white < 1e-10).alias("whitening_ok"))


@query()
def r48_karcher_centers(spark, d):
    out = centers.fit_centers(_cov4(spark, d).select("l_returnflag", "cov"), "AIRM", ["l_returnflag"])
    return out.select("l_returnflag", "geometry", "fit_n", F.transform("mean", lambda x: r6(x)).alias("mean"), (F.col("karcher_residual") <= 1e-7).alias("converged"))


@query()
def r49_airm_transform_isometry(spark, d):
    """AIRM distances of pairs before and after centering by flag, and their largest difference."""
    c = _cov4(spark, d).select("l_suppkey", "l_returnflag", "cov")
    moved = centers.transform(c, centers.fit_centers(c.select("l_returnflag", "cov"), "AIRM", ["l_returnflag"]), "AIRM", ["l_returnflag"])
    w = W.partitionBy("l_returnflag").orderBy("l_suppkey")
    both = c.join(moved.select("l_suppkey", "l_returnflag", F.col("cov").alias("moved")), ["l_suppkey", "l_returnflag"])
    p = both.withColumn("c2", F.lead("cov").over(w)).withColumn("m2", F.lead("moved").over(w)).where("c2 is not null")
    p = p.select("l_returnflag", spd.airm_distance("cov", "c2").alias("a"), spd.airm_distance("moved", "m2").alias("b"))
    return p.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("a")).alias("mean_distance"), (F.max(F.abs(F.col("a") - F.col("b"))) < 1e-10).alias("isometric"))


@query()
def r50_domain_shift(spark, d):
    out = stats.domain_shift(_cov4(spark, d).withColumn("coords", spd.log_svec("cov")).withColumnRenamed("l_returnflag", "domain"), "domain")
    return out.select("domain", "target_n", "source_n", *[r6(c).alias(c) for c in out.columns if c not in ("domain", "target_n", "source_n")])


@query()
def r51_logistic_probe_oof(spark, d):
    c = bridge.coordinates(spark, d).withColumn("fold", F.col("vec_id") % 3)
    out = learn.probe_summary(learn.logistic_probe(c, "label", "coords", max_iter=200), "label")
    return out.select("folds", "n", *[F.round(c, 4).alias(c) for c in ("accuracy_mean", "accuracy_std", "chance")])


@query()
def r52_loso_t1_t2(spark, d):
    """Leave one of three supplier groups out; the return flag is the class, supplier groups of six the runs."""
    c = _cov4(spark, d).select(F.concat_ws("-", F.col("l_suppkey").cast("string"), "l_returnflag").alias("trial_uid"), (F.col("l_suppkey") % 3 + 1).alias("subject"), (F.floor(F.col("l_suppkey") / 3) % 6).cast("string").alias("run"), "l_returnflag", "cov", spd.log_svec("cov").alias("coords"))
    out = protocol.loso(c, "l_returnflag", geometries=protocol.GEOMETRIES)
    return out.select("target", "geometry", "protocol", "split", "status", "transductive_overlap", "n", *[F.round(c, 4).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@query()
def r53_mdm_airm(spark, d):
    c = _cov4(spark, d)
    out = learn.nearest_mean_airm(c.where("l_suppkey % 5 <> 0"), c.where("l_suppkey % 5 = 0"), "l_returnflag", ["l_suppkey"])
    return out.withColumn("distance", r6("distance"))


@query()
def r54_pca_variance(spark, d):
    out = learn.pca_variance(bridge.coordinates(spark, d), "coords")
    return out.select("component", r6("explained").alias("explained"), r6("cumulative").alias("cumulative"))


@query()
def r55_leakage_audit(spark, d):
    c = bridge.coordinates(spark, d, 3).withColumn("fold", F.col("vec_id") % 2)
    out = protocol.leakage_audit(c, "subject", "label", "fold", "coords", 2, max_iter=200)
    return out.select("condition", "fold", "status", "n", *[F.round(x, 4).alias(x) for x in ("accuracy", "balanced_accuracy", "macro_f1")])


_EVIDENCE = f"""
{_STEPS}, b AS (SELECT class_label, window_pair, avg(magnitude) AS m FROM steps GROUP BY 1, 2),
ev AS (SELECT 'H' || (CAST(class_label AS INT) + 1) AS hypothesis, window_pair AS part, m - 15 AS value FROM b UNION ALL SELECT 'H' || (CAST(class_label AS INT) + 4), window_pair, (m - 15) / 10 FROM b),
vt AS (SELECT *, CASE WHEN value >= 0.02 THEN 1 WHEN value <= -0.02 AND hypothesis IN ('H1', 'H3') THEN -1 ELSE 0 END AS v FROM ev),
pt AS (SELECT hypothesis, part, count(*) FILTER (v > 0) AS pos, count(*) FILTER (v < 0) AS neg, count(*) AS n FROM vt GROUP BY 1, 2),
hh AS (SELECT hypothesis, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, CAST(sum(n) AS BIGINT) AS n, min(pos) AS least FROM pt GROUP BY 1)"""


@query(f"""WITH {_EVIDENCE} SELECT hypothesis, positives, negatives, n, CASE
 WHEN CASE hypothesis WHEN 'H1' THEN positives >= 2 AND negatives = 0 WHEN 'H2' THEN least >= 2 WHEN 'H3' THEN least >= 2 AND negatives = 0 ELSE positives >= n END THEN 'SUPPORTED'
 WHEN positives > 0 OR (hypothesis IN ('H1', 'H3') AND negatives > 0) THEN 'MIXED' ELSE 'NOT SUPPORTED' END AS verdict FROM hh""")
def q56_hypothesis_verdicts(spark, d):
    b = _steps(spark, d).groupBy("class_label", "window_pair").agg(F.avg("magnitude").alias("m"))
    k = F.col("class_label").cast("int")
    both = F.array(F.struct((k + 1).alias("h"), (F.col("m") - 15).alias("value")), F.struct((k + 4).alias("h"), ((F.col("m") - 15) / 10).alias("value")))
    ev = b.select(F.col("window_pair").alias("part"), F.inline(both)).select(F.concat(F.lit("H"), F.col("h").cast("string")).alias("hypothesis"), "part", "value", F.lit(0.02).alias("threshold"))
    return verdicts.hypotheses(ev.withColumn("both_ways", F.col("hypothesis").isin("H1", "H3")))


@query(f"""WITH {_COORDS}, c AS (SELECT subject, pos, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM l GROUP BY 1, 2), a AS (SELECT pos, sum(s) AS s, sum(q) AS q, sum(n) AS n FROM c GROUP BY 1),
m AS (SELECT c.subject, c.n AS tn, a.n - c.n AS sn, c.s / c.n AS tm, (a.s - c.s) / (a.n - c.n) AS sm, c.q / c.n AS tq, (a.q - c.q) / (a.n - c.n) AS sq FROM c JOIN a ON c.pos = a.pos)
SELECT subject, max(tn) AS target_n, CAST(max(sn) AS BIGINT) AS source_n, {_r('sqrt(sum((tm - sm) * (tm - sm)))')} AS mean_distance, {_r('sqrt(sum(tq - tm * tm))')} AS target_rms, {_r('sqrt(sum(sq - sm * sm))')} AS source_rms FROM m GROUP BY 1""")
def q57_domain_shift_coordinates(spark, d):
    out = stats.domain_shift(bridge.coordinates(spark, d), "subject")
    return out.select("subject", "target_n", "source_n", *[r6(c).alias(c) for c in ("mean_distance", "target_rms", "source_rms")])


@query()
def r58_geometry_gate(spark, d):
    """The full gate by subject: every statistic with its threshold."""
    rows = gates.gate_rows(gates.evaluate_scopes(_cov4(spark, d).select("subject", F.concat_ws("-", F.col("l_suppkey").cast("string"), "l_returnflag").alias("trial_uid"), "cov"), ["subject"]), ["subject"])
    return rows.select("subject", "statistic", "threshold", "comparator", "required", "passed", "status")


@query()
def r59_mean_comparison(spark, d):
    c = _cov4(spark, d).select("subject", "cov")
    le, airm, ea = (centers.fit_centers(c, g, ["subject"]) for g in ("LE", "AIRM", "EA"))
    out = stats.compare_means(le, airm, ea, ["subject"])
    return out.select("subject", "fit_n", *[r6(x).alias(x) for x in out.columns if x not in ("subject", "fit_n")])


from covarium.plans import closed_forms  # noqa: E402, F401 - it registers its queries above
