"""Effect sizes, distances between groups, transitions and domain shift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covarium.functions import spd
from covarium.functions.vectors import cosine, distance, group_mean_vector, max_abs, norm, sub

#: A silhouette compares every row with every other one; beyond this many rows it does so block by block.
SILHOUETTE_ROWS = 20_000
#: Rows of a block.
SILHOUETTE_BLOCK = 2_000


def six_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, std (ddof 1; NaN for one row), median, min, max."""
    v = F.col(value)
    std = F.coalesce(F.stddev_samp(v), F.lit(float("nan")))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), std.alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


def descriptive(df: DataFrame, group: str, pair: str, value: str) -> DataFrame:
    """Per group and scope (``all`` and each pair): n, mean, std (0 for one row), median; one pass by grouping sets."""
    query = f"""
        SELECT `{group}`, CASE WHEN grouping(`{pair}`) = 1 THEN 'all' ELSE CAST(`{pair}` AS STRING) END AS scope, count(`{value}`) AS n,
               avg(`{value}`) AS mean, coalesce(stddev_samp(`{value}`), 0D) AS std, median(`{value}`) AS median
        FROM {{rows}} GROUP BY GROUPING SETS ((`{group}`), (`{group}`, `{pair}`))"""
    return df.sparkSession.sql(query, rows=df)


def pair_summary(df: DataFrame, pair: str, value: str) -> DataFrame:
    return df.groupBy(pair).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))


def two_level_means(df: DataFrame, trial: list[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Means per trial then group, and one row: (max - min) of group means over the size of the mean of all trials."""
    trials = df.groupBy(*trial, group).agg(F.avg(value).alias("trial_mean"))
    groups = trials.groupBy(group).agg(F.avg("trial_mean").alias("mean"), F.count(F.lit(1)).alias("n"))
    total = F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    spread = groups.agg(((F.max("mean") - F.min("mean")) / F.greatest(F.abs(total), F.lit(float(np.finfo(float).eps)))).alias("range_fraction"), total.alias("overall"))
    return groups, spread


def eta_squared(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Share of the sum of squares between groups, 0 where there is none, within [0, 1]."""
    by = by or []
    g = df.groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    s = g.groupBy(*by).agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), grand.alias("grand"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("n") * F.col("grand") * F.col("grand")
    total = between + F.col("within")
    return s.select(*by, F.when(total <= 0, 0.0).otherwise(F.least(F.greatest(between / total, F.lit(0.0)), F.lit(1.0))).alias("eta_squared"), F.col("n").cast("long").alias("n"))


def rms_distance_ratio(df: DataFrame, label: str, vec: str) -> DataFrame:
    """RMS distance of all pairs of different labels over that of pairs of one label, from sums: no pair is formed.

    For n vectors with sum s and sum of squared norms q, pairs add up to n q - |s|^2.
    One row: between, within, ratio (+inf if only ``within`` is 0; an error if both are).
    """
    long = df.select(label, F.posexplode(vec).alias("pos", "v"))
    cells = long.groupBy(label, "pos").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    labels = cells.groupBy(label).agg(F.max("n").alias("n"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    within = labels.agg(F.sum(F.col("n") * F.col("q") - F.col("ss")).alias("w_sum"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("w_n"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    total = cells.groupBy("pos").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    both = within.crossJoin(total)  # one row with one row
    pairs = F.col("n") * (F.col("n") - 1) / 2
    wi = F.sqrt(F.greatest(F.try_divide("w_sum", "w_n"), F.lit(0.0)))
    be = F.sqrt(F.greatest(F.try_divide(F.col("n") * F.col("q") - F.col("ss") - F.col("w_sum"), pairs - F.col("w_n")), F.lit(0.0)))
    out = both.select(be.alias("between"), wi.alias("within"))
    ratio = F.when(F.col("within") > 0, F.col("between") / F.col("within")).when(F.col("between") > 0, float("inf")).otherwise(F.raise_error(F.lit("all distances are zero")).cast("double"))
    return out.withColumn("ratio", ratio)


def _widths(sums: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Silhouettes of rows from the sums of their distances to each label's rows."""
    i = np.arange(len(own))
    a = sums[i, own] / np.maximum(counts[own] - 1, 1)
    mean = sums / counts
    mean[i, own] = np.inf
    c = mean.min(axis=1)
    top = np.maximum(a, c)
    return np.where((counts[own] > 1) & (top > 0), (c - a) / np.where(top > 0, top, 1), 0.0)


def _silhouette_in_blocks(df: DataFrame, label: str, vec: str) -> DataFrame:
    """The same over all rows, however many: each pair of blocks is one row of a cross join, and only sums by label are shuffled."""
    seen = df.groupBy(F.col(label).cast("string").alias("label")).count().orderBy("label").collect()
    names, counts = np.array([r["label"] for r in seen], str), np.array([r["count"] for r in seen])
    order = np.argsort(names)
    names, counts = names[order], counts[order]
    if len(names) < 2 or len(names) >= counts.sum():
        raise ValueError("a silhouette needs between 2 and n - 1 labels")
    largest = df.agg(F.max(F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v * v))).first()[0]

    def pack(batches):
        task = TaskContext.get().partitionId() << 32
        k = 0
        for b in batches:
            for at in range(0, len(b), SILHOUETTE_BLOCK):
                part = b.iloc[at : at + SILHOUETTE_BLOCK]
                x = np.stack([np.asarray(v, float) for v in part["vec"]])
                yield pd.DataFrame({"block": [task + k], "x": [x.tobytes()], "own": [np.searchsorted(names, part["label"].to_numpy(str)).astype(np.int64).tobytes()]})
                k += 1

    blocks = df.select(F.col(label).cast("string").alias("label"), F.col(vec).alias("vec")).mapInPandas(pack, "block bigint, x binary, own binary").persist()

    def distances(batches):
        for b in batches:
            for r in b.itertuples():
                own, other = np.frombuffer(r.own, np.int64), np.frombuffer(r.o_own, np.int64)
                y, x = np.frombuffer(r.x).reshape(len(own), -1), np.frombuffer(r.o_x).reshape(len(other), -1)
                d = np.sqrt(np.maximum((x * x).sum(axis=1)[None] + (y * y).sum(axis=1)[:, None] - 2 * y @ x.T, 0))
                d[d < 1e-7 * np.sqrt(largest + 1e-300)] = 0.0
                yield pd.DataFrame({"block": [r.block], "own": [r.own], "sums": [(d @ np.eye(len(names))[other]).tobytes()]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(rows["own"].iloc[0], np.int64)
        sums = np.sum([np.frombuffer(v).reshape(len(own), -1) for v in rows["sums"]], axis=0)
        return pd.DataFrame({"s": _widths(sums, own, counts)})

    other = blocks.select(F.col("x").alias("o_x"), F.col("own").alias("o_own"))
    each = blocks.crossJoin(other).mapInPandas(distances, "block bigint, own binary, sums binary").groupBy("block").applyInPandas(finish, "s double")
    return each.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette(df: DataFrame, label: str, vec: str, max_rows: int | None = None) -> DataFrame:
    """Mean Euclidean silhouette over all rows: one row (silhouette, n).  More than ``max_rows`` rows are an error, if it is given.

    Quadratic by definition: up to SILHOUETTE_ROWS the rows are one block that every task has,
    and tasks take their own rows' distances to it; beyond, blocks meet pair by pair.
    """
    n = df.limit((max_rows or SILHOUETTE_ROWS) + 1).count()
    if max_rows is not None and n > max_rows:
        raise ValueError(f"a silhouette takes at most {max_rows} rows; take a balanced subset")
    if n > SILHOUETTE_ROWS:
        return _silhouette_in_blocks(df, label, vec)
    rows = df.select(F.col(label).cast("string").alias("label"), F.col(vec).alias("vec")).toPandas()
    names, code = np.unique(rows["label"].to_numpy(str), return_inverse=True)
    if len(names) < 2 or len(names) >= len(rows):
        raise ValueError("a silhouette needs between 2 and n - 1 labels")
    x = np.stack([np.asarray(v, float) for v in rows["vec"]])
    counts, squares = np.bincount(code), (x * x).sum(axis=1)

    def run(batches):
        member = np.eye(len(names))[code]
        for b in batches:
            y, own = np.stack([np.asarray(v, float) for v in b["vec"]]), np.searchsorted(names, b["label"].to_numpy(str))
            d = np.sqrt(np.maximum(squares[None] + (y * y).sum(axis=1)[:, None] - 2 * y @ x.T, 0))
            d[d < 1e-7 * np.sqrt(squares.max() + 1e-300)] = 0.0
            yield pd.DataFrame({"s": _widths(d @ member, own, counts)})

    each = df.select(F.col(label).cast("string").alias("label"), F.col(vec).alias("vec")).mapInPandas(run, "s double")
    return each.agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def transition_steps(df: DataFrame, trial: list[str], window: str, vec: str) -> DataFrame:
    """Differences of consecutive windows of each trial: trial, other columns, window_pair (``1-2``), delta, magnitude."""
    w = W.partitionBy(*trial).orderBy(window)
    before, index = F.lag(vec).over(w), F.lag(window).over(w)
    out = df.withColumn("t_before", before).withColumn("t_index", index).where("t_before is not null")
    out = out.withColumn("window_pair", F.concat_ws("-", F.col("t_index").cast("string"), F.col(window).cast("string")))
    out = out.withColumn("delta", sub(F.col(vec), F.col("t_before")))
    return out.withColumn("magnitude", norm(F.col("delta"))).drop("t_before", "t_index")


def invariance(raw: DataFrame, centered: DataFrame, key: list[str]) -> DataFrame:
    """Largest difference of steps before and after centering (they should be equal): one row (max_abs_error, holds)."""
    met = raw.select(*key, F.col("delta").alias("x")).join(centered.select(*key, F.col("delta").alias("y")), key)
    return met.agg(F.max(max_abs(sub(F.col("x"), F.col("y")))).alias("max_abs_error")).withColumn("holds", F.col("max_abs_error") <= 1e-10)


def class_cosines(steps: DataFrame, group: str, pair: str, vec: str = "delta") -> DataFrame:
    """Cosines of mean steps of all pairs of classes, over all pairs of windows and each: scope, class_a, class_b, cosine."""
    scoped = steps.select(group, F.explode(F.array(F.lit("all"), F.col(pair).cast("string"))).alias("scope"), vec)
    m = group_mean_vector(scoped, ["scope", group], vec, "m", "n")
    a, b = m.select("scope", F.col(group).alias("class_a"), F.col("m").alias("ma")), m.select(F.col("scope").alias("s"), F.col(group).alias("class_b"), F.col("m").alias("mb"))
    met = a.join(b, (F.col("scope") == F.col("s")) & (F.col("class_a") < F.col("class_b")))
    return met.select("scope", "class_a", "class_b", cosine(F.col("ma"), F.col("mb")).alias("cosine"))


def separability(coords: DataFrame, vec: str, labels: dict[str, str], name: str, window: str | None = None, sample: DataFrame | None = None) -> DataFrame:
    """Silhouette and RMS ratio for each label, and of each window: representation, metric, window, value.

    Only silhouettes over all windows are taken from ``sample``, if it is given.
    """
    spark, out = coords.sparkSession, None
    def put(df, metric, at):
        nonlocal out
        row = df.select(F.lit(name).alias("representation"), F.lit(metric).alias("metric"), F.lit(at).alias("window"), F.col("v").alias("value"))
        out = row if out is None else out.unionByName(row)
    chosen = coords if sample is None else sample
    windows = [k for (k,) in coords.select(window).distinct().orderBy(window).collect()] if window else []  # a handful of windows
    if window:
        put(silhouette(chosen, window, vec).select(F.col("silhouette").alias("v")), "window_silhouette", "all")
    for what, column in labels.items():
        put(silhouette(chosen, column, vec).select(F.col("silhouette").alias("v")), f"{what}_silhouette", "all")
        put(rms_distance_ratio(coords, column, vec).select(F.col("ratio").alias("v")), f"{what}_separation_ratio", "all")
        for k in windows:
            one = coords.where(F.col(window) == k)
            put(silhouette(one, column, vec).select(F.col("silhouette").alias("v")), f"{what}_silhouette", str(k))
            put(rms_distance_ratio(one, column, vec).select(F.col("ratio").alias("v")), f"{what}_separation_ratio", str(k))
    return out


def subject_structure(rows: DataFrame, vec: str, subject: str = "subject") -> DataFrame:
    """How far subjects stay apart after a transform, over all rows: one row (silhouette, separation_ratio, n)."""
    ratio = rms_distance_ratio(rows, subject, vec).select(F.col("ratio").alias("separation_ratio"))
    return silhouette(rows, subject, vec).crossJoin(ratio).select("silhouette", "separation_ratio", "n")  # single rows


def domain_components(coords: DataFrame, by: list[str], vec: str = "coords") -> DataFrame:
    """Log-Euclidean domain statistics: distance of the mean to the identity, RMS about the identity and about the mean."""
    m = group_mean_vector(coords, by, vec, "m", "n")
    met = coords.join(m, by).select(*by, "n", "m", norm(F.col(vec)).alias("d0"), distance(F.col(vec), F.col("m")).alias("d1"))
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    return met.groupBy(*by).agg(F.first("n").alias("n"), F.first(norm(F.col("m"))).alias("mean_to_identity"), rms("d0").alias("rms_identity"), rms("d1").alias("rms_mean"), F.first("m").alias("domain_mean"))


def domain_shift(coords: DataFrame, domain: str, vec: str = "coords") -> DataFrame:
    """Each domain as target against all others as source, from sums: no domain is gathered."""
    long = coords.select(domain, F.posexplode(vec).alias("pos", "v")).groupBy(domain, "pos").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    all_ = long.groupBy(F.col("pos").alias("p")).agg(F.sum("s").alias("as"), F.sum("q").alias("aq"), F.sum("n").alias("an"))
    met = long.join(all_, F.col("pos") == F.col("p"))
    tm, sm = F.col("s") / F.col("n"), (F.col("as") - F.col("s")) / (F.col("an") - F.col("n"))
    met = met.select(domain, "n", "an", (tm * tm).alias("t0"), (sm * sm).alias("s0"), ((tm - sm) * (tm - sm)).alias("gap"), (F.col("q") / F.col("n") - tm * tm).alias("tv"), ((F.col("aq") - F.col("q")) / (F.col("an") - F.col("n")) - sm * sm).alias("sv"))
    root = lambda c: F.sqrt(F.greatest(F.sum(c), F.lit(0.0)))
    return met.groupBy(domain).agg(
        F.first("n").alias("target_n"), (F.first("an") - F.first("n")).alias("source_n"), root("gap").alias("mean_distance"), root("t0").alias("target_mean_to_identity"), root("s0").alias("source_mean_to_identity"),
        root("tv").alias("target_rms"), root("sv").alias("source_rms"), (root("tv") - root("sv")).alias("rms_difference"),
    )


def compare_means(le: DataFrame, airm: DataFrame, ea: DataFrame, by: list[str]) -> DataFrame:
    """Distances between the three means of each scope, and their coordinate differences."""
    met = le.select(*by, "fit_n", F.col("mean").alias("le")).join(airm.select(*by, F.col("mean").alias("airm")), by).join(ea.select(*by, F.col("mean").alias("ea")), by)
    for k in ("le", "airm", "ea"):
        met = met.withColumn(f"z_{k}", spd.log_svec(k)).withColumn(f"d_{k}", spd.spd_diagnostics(k))
    z = lambda k: F.col(f"z_{k}")
    return met.select(
        *by, "fit_n", distance(z("le"), z("airm")).alias("le_airm_le_distance"), spd.airm_distance("le", "airm").alias("le_airm_airm_distance"),
        spd.airm_distance("ea", "airm").alias("ea_airm_airm_distance"), max_abs(sub(z("le"), z("airm"))).alias("max_abs_coordinate_difference"),
        (distance(z("le"), z("airm")) / norm(z("airm"))).alias("relative_coordinate_difference"),
        *[F.col(f"d_{k}.{e}_eigenvalue").alias(f"{k}_{e}_eigenvalue") for k in ("le", "airm", "ea") for e in ("min", "max")],
    )
