"""More registered queries with DuckDB SQL: operators whose results have a closed form or a plain relational one."""

from __future__ import annotations

from pyspark.sql import functions as F

from covarium.functions import digest, spd
from covarium.operators import centers, contracts, gates, learn, protocol, stats, trials, verdicts
from covarium.plans import bridge, report
from covarium.plans.catalog import _BA, _COORDS, _COV, _SAMPLES, _TRIALS, CLASSES, SEED, _ba, _r, query, r6
from covarium.sources import readers, sinks
from covarium.sources.readers import table


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


def _r4(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 4) + CAST(0 AS DOUBLE))"


GEOMETRIES = ["RAW", "LE", "AIRM", "EA"]
_FOLDS = _TRIALS + f""",
g AS (SELECT *, sha256('{{"seed":{SEED},"values":[{{"type":"int","value":"' || subject || '"}},{{"type":"str","value":"' || session || '"}},{{"type":"int","value":"' || trial_id || '"}}]}}') AS h FROM trials),
folds AS (SELECT trial_uid, subject, class_label, CAST((row_number() OVER (PARTITION BY subject, class_label ORDER BY h, trial_id) - 1) % 5 AS BIGINT) AS fold FROM g)"""


# --- tables, joins and contracts

@query("""WITH g AS (SELECT l_suppkey % 3 AS kind, l_linenumber AS geometry, CASE WHEN count(*) % 7 = 0 THEN 'FAILED' ELSE 'PASS' END AS status FROM lineitem GROUP BY l_suppkey, l_linenumber)
SELECT kind, geometry, count(*) AS n FROM g WHERE status = 'FAILED' GROUP BY 1, 2""")
def q60_failures_by_kind(spark, d):
    n = F.count(F.lit(1))
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.when(n % 7 == 0, "FAILED").otherwise("PASS").alias("status"))
    return verdicts.failures(g.select((F.col("l_suppkey") % 3).alias("kind"), F.col("l_linenumber").alias("geometry"), "status"), ["kind", "geometry"])


_LABELLED = _COORDS.replace("vec_id % 9 + 1 AS subject", "vec_id % 9 + 1 AS subject, vec_id % 9 + 1 AS who").replace("SELECT vec_id, label, subject, unnest", "SELECT vec_id, who AS label, subject, unnest")


@query(f"""WITH {_LABELLED}, c AS (SELECT label, pos, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT label, max(n) AS n, sum(q) AS q, sum(s * s) AS ss FROM c GROUP BY 1),
w AS (SELECT sum(n * q - ss) AS ws, sum(n * (n - 1) / 2) AS wn, sum(n) AS n, sum(q) AS q FROM k), t AS (SELECT sum(s * s) AS ss FROM (SELECT pos, sum(s) AS s FROM c GROUP BY 1)),
ra AS (SELECT sqrt((n * q - t.ss - ws) / (n * (n - 1) / 2 - wn)) / sqrt(ws / wn) AS ratio FROM w, t),
y AS (SELECT vec_id, vec_id % 9 + 1 AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nn AS (SELECT label, count(*) AS n FROM y GROUP BY 1),
p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.e, b.e)) AS s FROM y a, y b GROUP BY 1, 2, 3),
m AS (SELECT p.vec_id, max(CASE WHEN p.label = other THEN s / greatest(nn.n - 1, 1) END) AS a, min(CASE WHEN p.label <> other THEN s / nn.n END) AS b, max(CASE WHEN p.label = other THEN nn.n END) AS own FROM p JOIN nn ON nn.label = p.other GROUP BY 1),
si AS (SELECT avg(CASE WHEN own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS s, count(*) AS n FROM m)
SELECT {_r('s')} AS silhouette, {_r('ratio')} AS separation_ratio, n FROM si, ra""")
def q61_subject_structure(spark, d):
    out = stats.subject_structure(bridge.coordinates(spark, d), "coords")
    return out.select(r6("silhouette").alias("silhouette"), r6("separation_ratio").alias("separation_ratio"), "n")


@query(f"WITH {_SAMPLES} SELECT user_id, CAST(window_index AS BIGINT) AS window_index, " + ", ".join(_r(f"count(*) FILTER (event_type = '{c}') / count(*)") + f" AS probability__{c}" for c in CLASSES) + " FROM samples GROUP BY 1, 2")
def q62_probability_columns(spark, d):
    share = [r6(F.count_if(F.col("event_type") == c) / F.count(F.lit(1))) for c in CLASSES]
    s = bridge.window_samples(spark, d).groupBy("user_id", "window_index").agg(F.array(*share).alias("probabilities"))
    return learn.probability_columns(s, list(CLASSES)).drop("probabilities")


@query(f"WITH {_BA} SELECT t1.subject, {_r('t1.LE')} AS t1_le, {_r('t2.LE')} AS t2_le, {_r('t1.LE - t2.LE')} AS difference FROM t1 JOIN t2 ON t1.subject = t2.subject")
def q63_one_to_one_join(spark, d):
    t1, t2 = (t.select("subject", F.col("LE").alias(f"t{i}_le")) for i, t in enumerate(_ba(spark, d), 1))
    met = contracts.join_one_to_one(t1, t2, "subject")
    return met.select("subject", r6("t1_le").alias("t1_le"), r6("t2_le").alias("t2_le"), r6(F.col("t1_le") - F.col("t2_le")).alias("difference"))


@query(f"WITH {_FOLDS} SELECT subject, fold, count(*) * 5 AS n_windows, count(*) AS n_trials FROM folds WHERE fold <> 2 GROUP BY 1, 2")
def q64_fold_lookup_of_windows(spark, d):
    t = bridge.trial_table(spark, d)
    folds = trials.folds(t, 5, SEED, [("subject", "int"), ("session", "str"), ("trial_id", "int")])
    rows = contracts.lookup(trials.replicate_windows(t).select("trial_uid", "subject", "window_index"), folds, "trial_uid", "fold")
    return rows.where("fold <> 2").groupBy("subject", "fold").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("window_index") == 1).alias("n_trials"))


@query("""WITH e AS (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), o AS (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' AND (event_type <> 'search' OR event_id % 2 = 0) GROUP BY 1)
SELECT coalesce(o.event_type, e.event_type) AS event_type, e.n AS expected, o.n AS observed, coalesce(e.n = o.n, FALSE) AS passed FROM e FULL JOIN o ON e.event_type = o.event_type""")
def q65_summary_contract(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    n = lambda x: x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    odd = (F.col("event_type") != "click") & ((F.col("event_type") != "search") | (F.col("event_id") % 2 == 0))
    return contracts.compare(n(e.where("event_type <> 'view'")), n(e.where(odd)), ["event_type"], "n")


@query("""SELECT CAST(o_custkey % 9 + 1 AS BIGINT) AS subject, CAST(o_orderkey AS BIGINT) AS trial_id, o_orderstatus AS class_label,
CASE WHEN o_orderkey % 3 = 2 THEN CAST(o_totalprice AS DOUBLE) END AS value FROM orders""")
def q66_aliases_and_casts(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "NaN").when(F.col("o_orderkey") % 3 == 1, "no number").otherwise(F.col("o_totalprice").cast("string"))
    o = table(spark, d, "orders").select((F.col("o_custkey") % 9 + 1).cast("string").alias("subject"), F.col("o_orderkey").cast("string").alias("trial_id"), F.col("o_orderstatus").alias("label"), raw.alias("value"))
    return trials.normalise_aliases(o).withColumn("value", trials.finite_or_null(F.col("value")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS run, n_name AS class_label, CAST(n_regionkey AS BIGINT) AS subject, 'parquet' AS source FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS BIGINT), 'csv' FROM nation")
def q67_sink_round_trips(spark, d):
    """Written as Parquet and CSV, and read again with forced types: ``run`` "0" stays a string."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("run"), F.col("n_name").alias("class_label"), F.col("n_regionkey").cast("long").alias("subject"))
    at = sinks.scratch(spark)
    sinks.parquet(n, f"{at}/parquet")
    sinks.csv(n, f"{at}/csv")
    back = {"parquet": spark.read.parquet(f"{at}/parquet"), "csv": readers.csv(spark, f"{at}/csv", "run string, class_label string, subject bigint")}
    return back["parquet"].withColumn("source", F.lit("parquet")).unionByName(back["csv"].withColumn("source", F.lit("csv")))


# --- geometry of two channels through the general functions

@query(f"""WITH {_COV}, m AS (SELECT subject, avg(z0) AS a, avg(z1) / sqrt(2) AS b, avg(z2) AS d, count(*) AS fit_n FROM lg GROUP BY 1),
e AS (SELECT *, (a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS lo, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS hi FROM m),
k AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (exp(hi) - exp(lo)) / (hi - lo) END AS k FROM e)
SELECT subject, 'LE' AS geometry, fit_n, {_r('k * a + exp(lo) - k * lo')} AS m00, {_r('k * b')} AS m01, {_r('k * d + exp(lo) - k * lo')} AS m11, {_r('a')} AS z0, {_r('b * sqrt(2)')} AS z1, {_r('d')} AS z2 FROM k""")
def q68_log_euclidean_centers(spark, d):
    out = centers.fit_centers(bridge.covariances(spark, d).select("subject", "cov"), "LE", ["subject"])
    return out.select("subject", "geometry", "fit_n", *[r6(F.col("mean")[i]).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "m11"))], *[r6(F.col("log_mean")[i]).alias(f"z{i}") for i in range(3)])


@query(f"""WITH {_COV}, p AS (SELECT x.l_suppkey, x.a AS a1, x.b AS b1, x.d AS d1, sqrt(x.a * x.d - x.b * x.b) AS s1, y.a AS a2, y.b AS b2, y.d AS d2, sqrt(y.a * y.d - y.b * y.b) AS s2
  FROM cov x JOIN cov y ON x.l_suppkey = y.l_suppkey AND x.l_returnflag = 'A' AND y.l_returnflag = 'R'),
g AS (SELECT l_suppkey, s1, s2, a1 / s1 + a2 / s2 AS a, b1 / s1 + b2 / s2 AS b, d1 / s1 + d2 / s2 AS d FROM p), f AS (SELECT *, sqrt(s1 * s2) / sqrt(a * d - b * b) AS k FROM g)
SELECT l_suppkey, {_r4('k * a')} AS m00, {_r4('k * b')} AS m01, {_r4('k * d')} AS m11, TRUE AS converged FROM f""")
def q69_karcher_mean_of_two(spark, d):
    """The affine-invariant mean of two matrices is their geometric mean, which has a closed form for two channels."""
    c = bridge.covariances(spark, d).where("l_returnflag in ('A', 'R')").select("l_suppkey", "cov")
    out = centers.karcher_centers(c, ["l_suppkey"]).where("fit_n = 2")
    return out.select("l_suppkey", *[r4(F.col("mean")[i]).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "m11"))], (F.col("karcher_residual") <= 1e-7).alias("converged"))


@query(f"""WITH {_COV}, m AS (SELECT l_suppkey, avg(a) AS a, avg(b) AS b, avg(d) AS d FROM cov GROUP BY 1), q AS (SELECT *, sqrt(a * d - b * b) AS s FROM m), t AS (SELECT *, sqrt(a + d + 2 * s) AS t FROM q),
w AS (SELECT l_suppkey, (d + s) / (s * t) AS p, -b / (s * t) AS q, (a + s) / (s * t) AS r FROM t)
SELECT cov.l_suppkey, l_returnflag, {_r('p * p * a + 2 * p * q * b + q * q * d')} AS c00, {_r('p * q * a + (p * r + q * q) * b + q * r * d')} AS c01, {_r('q * q * a + 2 * q * r * b + r * r * d')} AS c11 FROM cov JOIN w ON cov.l_suppkey = w.l_suppkey""")
def q70_arithmetic_whitening(spark, d):
    c = bridge.covariances(spark, d).select("l_suppkey", "l_returnflag", "cov")
    out = centers.transform(c, centers.fit_centers(c.select("l_suppkey", "cov"), "EA", ["l_suppkey"]), "EA", ["l_suppkey"])
    return out.select("l_suppkey", "l_returnflag", *[r6(F.col("cov")[i]).alias(n) for i, n in ((0, "c00"), (1, "c01"), (3, "c11"))])


@query("""WITH s AS (SELECT var_samp(l_quantity / 50) AS a, covar_samp(l_quantity / 50, l_extendedprice / 100000) AS b, var_samp(l_extendedprice / 100000) AS d FROM lineitem),
e AS (SELECT a + d AS t, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS hi FROM s)
""" + f"SELECT 1 AS component, {_r('hi / t')} AS explained, {_r('hi / t')} AS cumulative FROM e UNION ALL SELECT 2, {_r('(t - hi) / t')}, {_r('1')} FROM e")
def q71_principal_components(spark, d):
    rows = table(spark, d, "lineitem").select(F.array((F.col("l_quantity") / 50).cast("double"), (F.col("l_extendedprice") / 100000).cast("double")).alias("v"))
    out = learn.pca_variance(rows, "v", 2)
    return out.select("component", r6("explained").alias("explained"), r6("cumulative").alias("cumulative"))


@query(f"""WITH {_COV}, q AS (SELECT *, sqrt(a * d - b * b) AS s FROM cov), t AS (SELECT *, sqrt(a + d + 2 * s) AS t FROM q)
SELECT lg.l_suppkey, lg.l_returnflag, {_r('z0')} AS z0, {_r('z1')} AS z1, {_r('z2')} AS z2, {_r4('(t.d + s) / (s * t)')} AS w00, {_r4('-t.b / (s * t)')} AS w01, {_r4('(t.a + s) / (s * t)')} AS w11, {_r('t.a')} AS back00, {_r('t.b')} AS back01, {_r('t.d')} AS back11
FROM lg JOIN t ON lg.l_suppkey = t.l_suppkey AND lg.l_returnflag = t.l_returnflag""")
def q72_spectral_functions(spark, d):
    """Logarithm, inverse root, and the exponential of the logarithm, by eigendecomposition."""
    c = bridge.covariances(spark, d).withColumn("z", spd.log_svec("cov")).withColumn("w", spd.spd_invsqrt("cov")).withColumn("back", spd.symmetric_exp(spd.spd_log("cov")))
    at = ((0, "00"), (1, "01"), (3, "11"))
    return c.select("l_suppkey", "l_returnflag", *[r6(F.col("z")[i]).alias(f"z{i}") for i in range(3)], *[r4(F.col("w")[i]).alias(f"w{n}") for i, n in at], *[r6(F.col("back")[i]).alias(f"back{n}") for i, n in at])


_SCOPES = _COV + """,
sc AS (SELECT *, CAST(floor(l_suppkey / 9) % 6 AS BIGINT) AS run FROM ev),
scopes AS (SELECT subject, 'T1' AS protocol, 'ALL' AS split, lo, hi FROM sc UNION ALL SELECT subject, 'T2', 'A', lo, hi FROM sc WHERE run < 3 UNION ALL SELECT subject, 'T2', 'B', lo, hi FROM sc WHERE run >= 3)"""


@query(f"""WITH {_SCOPES}, v AS (SELECT subject, protocol, split, count(*) FILTER (lo <= 0) AS bad, min(lo) AS least, max(hi / lo) AS cond FROM scopes GROUP BY 1, 2, 3)
SELECT subject, protocol, split, 'non_spd_count' AS statistic, {_r('bad')} AS value, '<=' AS comparator, TRUE AS required, bad = 0 AS passed FROM v
UNION ALL SELECT subject, protocol, split, 'minimum_eigenvalue', {_r('least')}, '>', TRUE, least > 0 FROM v UNION ALL SELECT subject, protocol, split, 'maximum_condition_number', {_r4('cond')}, '<=', TRUE, cond <= 1e12 FROM v""")
def q73_gate_scopes(spark, d):
    """Of the gate's rows, those with a closed form; 27 scopes: T1 over all runs, T2 over either half."""
    c = bridge.covariances(spark, d).withColumn("run", (F.floor(F.col("l_suppkey") / 9) % 6).cast("string"))
    c = c.withColumn("trial_uid", F.concat_ws("-", F.col("l_suppkey").cast("string"), "l_returnflag"))
    halves = protocol.calibration_halves(c).where("part = 'calibration'").withColumn("protocol", F.lit("T2"))
    scopes = c.withColumns({"protocol": F.lit("T1"), "split": F.lit("ALL")}).select("subject", "protocol", "split", "trial_uid", "cov").unionByName(halves.select("subject", "protocol", "split", "trial_uid", "cov"))
    by = ["subject", "protocol", "split"]
    rows = gates.gate_rows(gates.evaluate_scopes(scopes, by), by).where("statistic in ('non_spd_count', 'minimum_eigenvalue', 'maximum_condition_number')")
    return rows.select(*by, "statistic", F.when(F.col("statistic") == "maximum_condition_number", r4("value")).otherwise(r6("value")).alias("value"), "comparator", "required", "passed")


# --- results, reports, provenance

@query("SELECT 'labels' AS source, " + ", ".join(f"count(*) FILTER (quality = {t} AND toxic = {p}) AS cell__{t}__{p}" for t in (0, 1) for p in (0, 1)) + " FROM labels")
def q74_confusion_cells(spark, d):
    rows = table(spark, d, "labels").where("quality is not null and toxic is not null").withColumn("source", F.lit("labels"))
    cells = learn.confusion(rows, "quality", "toxic", ["0", "1"], ["source"])
    return learn.confusion_cells(cells, ["0", "1"], ["source"])


@query("SELECT * FROM (VALUES ('fit_centers', TRUE), ('transform', TRUE), ('log_euclidean_centers', TRUE), ('arithmetic_centers', TRUE), ('karcher_centers', TRUE), ('fit_logistic', FALSE)) t(name, label_free)")
def q75_label_barrier(spark, d):
    """Fits of centers and transforms have no parameter for labels; the classifier's fit does."""
    of = [centers.fit_centers, centers.transform, centers.log_euclidean_centers, centers.arithmetic_centers, centers.karcher_centers, learn.fit_logistic]
    return spark.createDataFrame(trials.label_free_signatures(of), "name string, label_free boolean")


@query(f"""WITH {_BA}, s AS (SELECT subject, geometry, round(avg(v) FILTER (o_orderstatus = 'O'), 9) AS x, round(avg(v) FILTER (o_orderstatus = 'F'), 9) AS y, round(avg(v) FILTER (o_orderstatus IN ('O', 'F')), 9) AS z FROM g WHERE geometry IS NOT NULL GROUP BY 1, 2)
SELECT subject, geometry, {_r('(x + y) / 2')} AS mean_ab, {_r('z')} AS aggregate FROM s WHERE abs((x + y) / 2 - z) > 0.002""")
def q76_aggregate_identity(spark, d):
    geometry = F.when(F.col("c_mktsegment") == "BUILDING", "RAW").when(F.col("c_mktsegment") == "AUTOMOBILE", "LE").when(F.col("c_mktsegment") == "MACHINERY", "AIRM").when(F.col("c_mktsegment") == "HOUSEHOLD", "EA")
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 9 + 1).alias("subject"), geometry.alias("geometry")).where("geometry is not null")
    g = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 500000).alias("v"), "o_orderstatus").where("o_orderstatus in ('O', 'F')").join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = g.withColumn("split", F.explode(F.array(F.when(F.col("o_orderstatus") == "O", "A").otherwise("B"), F.lit("AGGREGATE"))))
    rows = g.groupBy("subject", "geometry", "split").agg(F.round(F.avg("v"), 9).alias("balanced_accuracy"))
    out = verdicts.aggregate_identity(rows, ["subject", "geometry"], tolerance=0.002)
    return out.select("subject", "geometry", r6("mean_ab").alias("mean_ab"), r6("aggregate").alias("aggregate"))


def _results(spark, d):
    t1, t2 = _ba(spark, d)
    long = lambda t, split: t.unpivot(["subject"], GEOMETRIES, "geometry", "balanced_accuracy").withColumn("split", F.lit(split))
    return long(t1, "ALL").unionByName(long(t2, "AGGREGATE")).withColumnRenamed("subject", "target")


@query(f"WITH {_BA} SELECT t1.subject AS target, " + ", ".join(f"{_r(f't{i}.{x}')} AS t{i}_{x}" for i in (1, 2) for x in GEOMETRIES) + " FROM t1 JOIN t2 ON t1.subject = t2.subject")
def q77_figure_source_t1_t2(spark, d):
    none = spark.createDataFrame([], "target bigint")
    out = report.figure_sources(_results(spark, d), none, none)["figure_3_t1_vs_t2_ba"]
    return out.select("target", *[r6(f"t{i}_{x}").alias(f"t{i}_{x}") for i in (1, 2) for x in GEOMETRIES])


@query("SELECT 'orders' AS block, o_orderstatus AS name, count(*) AS n, CAST(NULL AS BIGINT) AS largest FROM orders GROUP BY 2 UNION ALL SELECT 'events', event_type, NULL, max(event_id) FROM events GROUP BY 2")
def q78_long_summary(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.max("event_id").cast("long").alias("largest"))
    return report.long_summary({"orders": o, "events": e}).select("block", "name", "n", "largest")


@query(f"""WITH {_BA}, s AS (SELECT subject, LE FROM t1) SELECT 'whole_raw' AS representation, 'class_silhouette' AS metric, CAST(subject AS VARCHAR) AS "window", {_r('LE')} AS value FROM s
UNION ALL SELECT 'window5_centered', 'subject_separation_ratio', CAST(subject AS VARCHAR), {_r('LE')} FROM s""")
def q79_separability_names(spark, d):
    """Free-form names of a results table become canonical ones; rows of other metrics go."""
    t = _ba(spark, d)[0].select("subject", r6("LE").alias("value"))
    kinds = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("representation", "state", "metric"), x)]) for x in (("WHOLE trial", "Raw", "Silhouette (class)"), ("5-Window ", "centered=True", "Subject distance RATIO"), ("whole", "raw", "other"))])
    return report.separability_scores(t.select(F.col("subject").alias("window"), "value", F.inline(kinds)))


@query("""WITH h AS (SELECT sha256(n_nationkey || '|' || n_name) AS h FROM nation),
w AS (SELECT sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS b, sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) AS c, sum(CAST('0x' || substr(h, 46, 15) AS HUGEINT)) AS d, count(*) AS n FROM h)
SELECT n, sha256(concat_ws('|', a, b, c, d, n)) AS content_sha256 FROM w""")
def q80_content_hash(spark, d):
    n = table(spark, d, "nation").select(F.sha2(F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name"), 256).alias("h"))
    return n.agg(F.count(F.lit(1)).alias("n"), digest.content_hash(F.col("h")).alias("content_sha256"))
