"""Decoders and their metrics."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covarium.functions import spd
from covarium.functions.vectors import distance, group_mean_vector
from covarium.operators.centers import karcher_centers


class FitAudit(dict):
    """status (PASS, or FAILED without convergence), iterations, train_n, regParam."""


def fit_logistic(train: DataFrame, label: str, vec: str, c: float = 1.0, max_iter: int = 5000, tol: float = 1e-6):
    """Multinomial logistic regression with an L2 penalty, unscaled: (model or None, class names, FitAudit).

    The penalty is that of a sum of losses times ``c``; Spark averages losses, hence 1 / (c n).
    A fit that uses up ``max_iter`` is FAILED.
    """
    names = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]  # classes
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)) - 1
    rows = train.select(place.cast("double").alias("y"), array_to_vector(F.col(vec)).alias("x")).persist()
    try:
        n = rows.count()
        model = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol).fit(rows)
    finally:
        rows.unpersist()
    steps = model.summary.totalIterations
    return model, names, FitAudit(status="PASS" if steps < max_iter else "FAILED", iterations=steps, train_n=n)


def _packed(rows: DataFrame, names: list, domains: list, label: str, vec: str, domain: str, space: str) -> DataFrame:
    """A row per Arrow batch and ``space``: x (vectors and a one), y and domain (places in ``names`` and ``domains``), as bytes."""
    place = lambda of, c: (F.array_position(F.array(*[F.lit(v) for v in of]), F.col(c)) - 1).alias(c)

    def run(batches):
        for b in batches:
            for g, own in b.groupby("p_space"):
                x = np.stack([np.asarray(v, float) for v in own["p_vec"]])
                x = np.c_[x, np.ones(len(x))]
                yield pd.DataFrame({"space": [g], "d": [x.shape[1]], "x": [x.tobytes()], "y": [own[label].to_numpy(np.int64).tobytes()], "domain": [own[domain].to_numpy(np.int64).tobytes()]})

    flat = rows.select(F.col(space).alias("p_space"), F.col(vec).alias("p_vec"), place(names, label), place(domains, domain)).where(F.col(domain) >= 0)
    return flat.mapInPandas(run, "space string, d int, x binary, y binary, domain binary")


def _blocks(b: pd.DataFrame):
    for r in b.itertuples():
        yield r.space, np.frombuffer(r.x).reshape(-1, r.d), np.frombuffer(r.y, np.int64), np.frombuffer(r.domain, np.int64)


def _losses(blocks: DataFrame, at: dict, absent: dict) -> dict:
    """For each (space, domain) in ``at``: sum of the losses of the other domains' rows and its gradient, all in one pass."""
    def run(batches):
        total = {}
        for b in batches:
            for g, x, y, own in _blocks(b):
                for (space, k), w in at.items():
                    if space == g:
                        keep = own != k
                        xs, ys = x[keep], y[keep]
                        z = xs @ w + absent[space, k]
                        z -= z.max(axis=1, keepdims=True)
                        e = np.exp(z)
                        q = e.sum(axis=1)
                        p = e / q[:, None]
                        loss = float((np.log(q) - z[np.arange(len(ys)), ys]).sum())
                        p[np.arange(len(ys)), ys] -= 1
                        had = total.get((space, k), (0.0, 0.0))
                        total[space, k] = had[0] + loss, had[1] + xs.T @ p
        yield pd.DataFrame([(g, k, f, np.ascontiguousarray(d).tobytes()) for (g, k), (f, d) in total.items()], columns=["space", "k", "f", "g"])

    out = {m: [0.0, np.zeros_like(w)] for m, w in at.items()}
    for r in blocks.mapInPandas(run, "space string, k bigint, f double, g binary").toLocalIterator():
        out[r.space, r.k][0] += r.f
        out[r.space, r.k][1] += np.frombuffer(r.g).reshape(out[r.space, r.k][1].shape)
    return out


class _Descent:
    """L-BFGS on one model, whose loss and gradient at ``x`` come from outside; the first metric is the bound (half the Gram matrix) of the Hessian."""

    def __init__(self, gram: np.ndarray, n: int, shape: tuple, c: float, max_iter: int, tol: float):
        self.n, self.max_iter, self.tol, self.steps, self.done = max(n, 1), max_iter, tol, 0, False
        self.pull = np.r_[np.full(shape[0] - 1, 1.0 / (c * self.n)), 0.0][:, None]
        metric = gram / (2 * self.n) + np.diag(self.pull[:, 0])
        self.metric = np.linalg.pinv(metric, hermitian=True)
        self.x, self.f, self.pairs, self.way, self.t = np.zeros(shape), None, [], None, 1.0

    @property
    def at(self) -> np.ndarray:
        return self.x if self.f is None else self.x + self.t * self.way

    def take(self, loss: float, gradient: np.ndarray) -> None:
        x = self.at
        f, g = loss / self.n + 0.5 * float((self.pull * x * x).sum()), gradient / self.n + self.pull * x
        if self.f is not None:
            if f > self.f + 1e-4 * self.t * float((self.g * self.way).sum()) and self.t > 1e-9:
                self.t /= 2
                return
            if f > self.f:  # no step is better: at the precision of sums
                self.done = True
                return
            self.steps += 1
            if float(((x - self.x) * (g - self.g)).sum()) > 0:
                self.pairs = [*self.pairs[-9:], (x - self.x, g - self.g)]
        still = self.f is not None and self.f - f <= 1e-14 * abs(f)
        self.x, self.f, self.g, self.t = x, f, g, 1.0
        self.done = bool(np.abs(g).max() <= self.tol * max(1.0, abs(f)) or still or self.steps >= self.max_iter)
        q, back = g.copy(), []
        for s, y in reversed(self.pairs):
            back.append(float((s * q).sum() / (s * y).sum()))
            q -= back[-1] * y
        q = self.metric @ q
        for (s, y), a in zip(self.pairs, reversed(back)):
            q += s * (a - float((y * q).sum() / (s * y).sum()))
        self.way = -q


def fit_leaving_out(rows: DataFrame, names: list, domains: list, label: str, vec: str, domain: str, space: str, c: float = 1.0, max_iter: int = 5000, tol: float = 1e-6) -> tuple[dict, dict]:
    """The models of ``fit_logistic`` for every ``space`` and every domain left out: weights (a row per entry of ``vec`` and one for the intercept), and FitAudits, by (space, place of the domain).

    A pass over the rows serves a step of all models, so the number of jobs is that of the slowest
    model's steps.  A class that a model's rows don't have gets no probability.
    """
    # every pass reads each block once: no more tasks than can run at once
    blocks = _packed(rows, names, domains, label, vec, domain, space).coalesce(rows.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        def run(batches):
            for b in batches:
                for g, x, y, own in _blocks(b):
                    for k in np.unique(own):
                        mine = x[own == k]
                        yield pd.DataFrame({"space": [g], "k": [int(k)], "n": [np.bincount(y[own == k], minlength=len(names)).tolist()], "gram": [(mine.T @ mine).tobytes()]})

        sums = {}
        for r in blocks.mapInPandas(run, "space string, k bigint, n array<bigint>, gram binary").toLocalIterator():
            had = sums.setdefault((r.space, r.k), [0, 0.0])
            gram = np.frombuffer(r.gram)
            had[0], had[1] = had[0] + np.array(r.n), had[1] + gram.reshape(int(len(gram) ** 0.5), -1)
        models, absent = {}, {}
        for g in sorted({g for g, _ in sums}):
            for k in range(len(domains)):
                others = [v for (space, j), v in sums.items() if space == g and j != k]
                n, gram = (sum(v[0] for v in others), sum(v[1] for v in others)) if others else (np.zeros(len(names)), np.zeros_like(next(iter(sums.values()))[1]))
                models[g, k] = _Descent(gram, int(n.sum()), (len(gram), len(names)), c, max_iter, tol)
                absent[g, k] = np.where(n > 0, 0.0, -1e30) if n.sum() else np.zeros(len(names))
        while left := {m: d.at for m, d in models.items() if not d.done}:
            for m, (f, g) in _losses(blocks, left, absent).items():
                models[m].take(f, g)
    finally:
        blocks.unpersist()
    audits = {m: FitAudit(status="PASS" if d.steps < max_iter else "FAILED", iterations=d.steps, train_n=d.n) for m, d in models.items()}
    weights = {}
    for m, d in models.items():
        weights[m] = d.x.copy()
        weights[m][-1] += absent[m]
    return weights, audits


def predict(model, names: list, df: DataFrame, vec: str) -> DataFrame:
    """Adds predicted and probabilities (in the order of ``names``; ties go to the first)."""
    out = model.setFeaturesCol("x_vec").setPredictionCol("x_pred").setProbabilityCol("x_prob").setRawPredictionCol("x_raw").transform(df.withColumn("x_vec", array_to_vector(F.col(vec))))
    p = vector_to_array(F.col("x_prob"))
    out = out.withColumn("probabilities", p).withColumn("predicted", F.get(F.array(*[F.lit(n) for n in names]), (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int")))
    return out.drop("x_vec", "x_pred", "x_prob", "x_raw")


def probability_columns(df: DataFrame, names: list, probabilities: str = "probabilities") -> DataFrame:
    """``df`` with a column probability__<class> for each class; names that collide are an error."""
    new = [f"probability__{n}" for n in names]
    if len({c.lower() for c in [*df.columns, *new]}) < len(df.columns) + len(new):
        raise ValueError(f"probability columns collide: {new}")
    return df.select("*", *[F.get(probabilities, F.lit(i)).alias(c) for i, c in enumerate(new)])


def model_hash(model, names: list) -> str:
    """SHA-256 of a fitted model's classes, coefficients and intercepts."""
    state = hashlib.sha256("\x1f".join(map(str, names)).encode())
    for part in (model.coefficientMatrix.toArray(), model.interceptVector.toArray()):
        state.update(str(part.shape).encode() + np.ascontiguousarray(part, "<f8").tobytes())
    return state.hexdigest()


def confusion_cells(cells: DataFrame, names: list, by: list[str]) -> DataFrame:
    """Confusion counts as columns, one row for each ``by``: cell__<truth>__<predicted>."""
    each = [F.sum(F.when((F.col("truth") == t) & (F.col("predicted") == p), F.col("n")).otherwise(0)).cast("long").alias(f"cell__{t}__{p}") for t in names for p in names]
    return cells.groupBy(*by).agg(*each)


def logistic_probe(rows: DataFrame, label: str, vec: str, fold: str = "fold", **fit) -> DataFrame:
    """Out-of-fold predictions: rows with predicted and probabilities; one model per fold."""
    out = None
    for (k,) in rows.select(fold).distinct().orderBy(fold).collect():  # a handful of folds
        model, names, _ = fit_logistic(rows.where(F.col(fold) != k), label, vec, **fit)
        part = predict(model, names, rows.where(F.col(fold) == k), vec)
        out = part if out is None else out.unionByName(part)
    return out


def probe_summary(predicted: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """One row: pooled accuracy, its std over folds (ddof 1), number of folds and rows, chance."""
    hit = (F.col(label) == F.col("predicted")).cast("double")
    per = predicted.groupBy(fold).agg(F.avg(hit).alias("a"), F.count(F.lit(1)).alias("n"), F.collect_set(label).alias("l"))
    return per.agg((F.sum(F.col("a") * F.col("n")) / F.sum("n")).alias("accuracy_mean"), F.stddev_samp("a").alias("accuracy_std"), F.count(F.lit(1)).alias("folds"), F.sum("n").alias("n"), (1.0 / F.size(F.array_distinct(F.flatten(F.collect_list("l"))))).alias("chance"))


def vote(predicted: DataFrame, trial: list[str], label: str, names: list, probabilities: str = "probabilities") -> DataFrame:
    """Mean probabilities over a trial's windows, then the largest (first of ties): trial, truth, predicted, n_windows."""
    p = [F.avg(F.get(probabilities, F.lit(i))) for i in range(len(names))]
    out = predicted.groupBy(*trial).agg(F.first(label).alias("truth"), F.count(F.lit(1)).alias("n_windows"), F.array(*p).alias("probabilities"))
    place = F.array_position("probabilities", F.array_max("probabilities")) - 1
    return out.withColumn("predicted", F.get(F.array(*[F.lit(n) for n in names]), place.cast("int")))


def confusion(df: DataFrame, truth: str, predicted: str, names: list, by: list[str] | None = None) -> DataFrame:
    """Counts on the full K x K grid in the order of ``names``: by, truth, predicted, n."""
    by = by or []
    k = df.sparkSession.createDataFrame([(t, p) for t in names for p in names], "g_truth string, g_predicted string")
    seen = df.groupBy(*by, F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("c_n"))
    grid = seen.select(*by).distinct().crossJoin(F.broadcast(k)) if by else k  # K x K cells for each group
    same = (F.col("g_truth") == F.col("truth")) & (F.col("g_predicted") == F.col("predicted"))
    right = seen.withColumnsRenamed({b: f"s_{b}" for b in by})
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"s_{b}"))
    return grid.join(right, same, "left").select(*by, F.col("g_truth").alias("truth"), F.col("g_predicted").alias("predicted"), F.coalesce("c_n", F.lit(0)).cast("long").alias("n"))


def metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """From confusion cells: n, accuracy, balanced_accuracy (over classes present in truth), macro_f1 (over all, 0 for 0/0), recalls."""
    by = by or []
    rows = cells.groupBy(*by, F.col("truth").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    cols = cells.groupBy(*[F.col(b).alias(f"p_{b}") for b in by], F.col("predicted").alias("p_k")).agg(F.sum("n").alias("claimed"))
    same = F.col("k") == F.col("p_k")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"p_{b}"))
    c = rows.join(cols, same).withColumn("recall", F.when(F.col("support") > 0, F.col("hit") / F.col("support")))
    c = c.withColumn("f1", F.when(F.col("support") + F.col("claimed") > 0, 2 * F.col("hit") / (F.col("support") + F.col("claimed"))).otherwise(0.0))
    recalls = F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("recall", F.lit(0.0)).alias("r")))), lambda s: s["r"])
    agg = [F.sum("support").cast("long").alias("n"), (F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"), recalls.alias("recalls")]
    return c.groupBy(*by).agg(*agg) if by else c.agg(*agg)


def nearest_mean(train: DataFrame, test: DataFrame, label: str, vec: str, key: list[str]) -> DataFrame:
    """Minimum distance to the mean in log-Euclidean coordinates: key, truth, predicted, distance; ties go to the smallest label.

    There are as many means as classes, so they are broadcast.
    """
    m = group_mean_vector(train, [label], vec, "m", "m_n").select(F.col(label).alias("m_label"), "m")
    met = test.select(*key, F.col(label).alias("truth"), vec).crossJoin(F.broadcast(m)).withColumn("d", distance(F.col(vec), F.col("m")))
    best = F.min(F.struct("d", "m_label"))
    return met.groupBy(*key, "truth").agg(best.alias("b")).select(*key, "truth", F.col("b.m_label").alias("predicted"), F.col("b.d").alias("distance"))


def nearest_mean_airm(train: DataFrame, test: DataFrame, label: str, key: list[str]) -> DataFrame:
    """The same with affine-invariant means and distances, over ``cov``."""
    m = karcher_centers(train, [label]).select(F.col(label).alias("m_label"), F.col("mean").alias("m"))
    met = test.select(*key, F.col(label).alias("truth"), "cov").crossJoin(F.broadcast(m)).withColumn("d", spd.airm_distance("m", "cov"))
    return met.groupBy(*key, "truth").agg(F.min(F.struct("d", "m_label")).alias("b")).select(*key, "truth", F.col("b.m_label").alias("predicted"), F.col("b.d").alias("distance"))


def pca_variance(df: DataFrame, vec: str, k: int = 40) -> DataFrame:
    """(component, explained, cumulative) of the first min(k, d, n - 1) components."""
    x = df.select(array_to_vector(F.col(vec)).alias("x"))
    n, d = x.count(), len(x.first()[0])
    model = PCA(k=max(1, min(k, d, n - 1)), inputCol="x", outputCol="z").fit(x)
    e = model.explainedVariance.toArray()
    return df.sparkSession.createDataFrame([(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(e, np.cumsum(e)))], "component int, explained double, cumulative double")


def pca_plane(df: DataFrame, vec: str, keep: list[str]) -> DataFrame:
    """First two principal coordinates, in place of a t-SNE picture."""
    x = df.select(*keep, array_to_vector(F.col(vec)).alias("x"))
    z = PCA(k=2, inputCol="x", outputCol="z").fit(x).transform(x)
    return z.select(*keep, vector_to_array("z")[0].alias("pc1"), vector_to_array("z")[1].alias("pc2"))
