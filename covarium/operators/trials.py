"""Trial identity, projections, casts and deterministic subsets."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covarium.functions.digest import pair_digest, tagged_digest, typed_digest
from covarium.operators.ranking import running_number

#: Columns that a fit may see.  Fixed values.
IDENTITY = ["subject", "session", "run", "trial_id", "trial_uid"]
SEED = 20260809
_SPACE_KEY = 3


def with_identity(df: DataFrame, order: list, coarse: Column, runs: int = 6) -> DataFrame:
    """Adds trial_id, run, run_trial_id and trial_uid; ``order`` is total within (subject, session)."""
    out = running_number(df, ["subject", "session"], order, coarse, "trial_id")
    out = out.withColumn("run", F.pmod(F.col("trial_id") - 1, F.lit(runs)).cast("string"))
    out = running_number(out, ["subject", "session", "run"], ["trial_id"], F.floor(F.col("trial_id") / 100_000), "run_trial_id")
    return out.withColumn("trial_uid", F.format_string("S%02d_%s_T%03d", "subject", "session", "trial_id"))


def replicate_windows(trials: DataFrame, n_windows: int = 5, index: str = "sample_index") -> DataFrame:
    """A row per trial and window 1..n, with covariance_index trial-major."""
    out = trials.withColumn("window_index", F.explode(F.sequence(F.lit(1), F.lit(n_windows)).cast("array<long>")))
    return out.withColumn("covariance_index", (F.col(index) * n_windows + F.col("window_index") - 1).cast("long"))


def normalise_aliases(df: DataFrame) -> DataFrame:
    """``class`` or ``label`` become ``class_label``; subject and trial_id become long."""
    for alias in ("class", "label"):
        if "class_label" not in df.columns and alias in df.columns:
            df = df.withColumnRenamed(alias, "class_label")
    missing = {"subject", "trial_id", "class_label"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df.withColumns({c: strict_long(F.col(c)) for c in ("subject", "trial_id")})


def strict_long(c: Column) -> Column:
    """A long; an error for null and for what is no whole number."""
    number = c.try_cast("double")
    return F.when(number.isNotNull() & (number == F.floor(number)), c.try_cast("double").cast("long")).otherwise(F.raise_error(F.concat(F.lit("no whole number: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("long"))


def strict_boolean(c: Column, digits: bool = False) -> Column:
    """True or False only by exact text (0 and 1 too with ``digits``); an error otherwise."""
    text = c.cast("string")
    yes, no = ["True", "true"], ["False", "false"]
    if digits:
        yes, no = [*yes, "1"], [*no, "0"]
    return F.when(text.isin(yes), F.lit(True)).when(text.isin(no), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def label_free(df: DataFrame) -> DataFrame:
    """Identity columns only: what a fit gets to see."""
    return df.select(*IDENTITY)


def assert_label_free(df: DataFrame, allowed: set[str] = frozenset()) -> None:
    """An error if a label column reaches a fit."""
    labels = {"class_label", "label", "class", "y", "true_label", "target_label"} - set(allowed)
    found = labels & set(df.columns)
    if found:
        raise ValueError(f"a fit must not see {sorted(found)}")


def label_free_signatures(functions: list) -> list[tuple[str, bool]]:
    """(name, whether no parameter names a label) of functions that fit or transform targets."""
    banned = ("label", "class", "truth", "y")
    return [(f.__name__, not any(p == b or b != "y" and b in p for p in inspect.signature(f).parameters for b in banned)) for f in functions]


def token(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c.cast("string"))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_metric(name: Column) -> Column:
    """subject/class/window silhouette or subject/class separation ratio; null for other names."""
    t = token(name)
    sil = t.contains("silhouette")
    ratio = t.contains("ratio")
    out = F.when(sil & t.contains("subject"), "subject_silhouette").when(sil & t.contains("class"), "class_silhouette").when(sil & t.contains("window"), "window_silhouette")
    return out.when(ratio & t.contains("subject"), "subject_separation_ratio").when(ratio & t.contains("class"), "class_separation_ratio")


def canonical_representation(representation: Column, state: Column) -> Column:
    """whole/window5 and raw/centered from free-form names; an error where either can't be told."""
    t = F.concat_ws("_", token(representation), token(state))
    base = F.when(t.contains("window"), "window5").when(t.contains("whole"), "whole").otherwise(F.raise_error(F.concat(F.lit("unknown representation: "), t)).cast("string"))
    kind = F.when(t.contains("center") | t.endswith("_true"), "centered").when(t.contains("raw") | t.endswith("_false"), "raw")
    return F.concat_ws("_", base, kind.otherwise(F.raise_error(F.concat(F.lit("unknown state: "), t)).cast("string")))


def canonical_target(name: Column) -> Column:
    t = token(name)
    return F.when(t.contains("class"), "class").when(t.contains("subject"), "subject").otherwise(F.raise_error(F.concat(F.lit("unknown target: "), t)).cast("string"))


def finite_or_null(c: Column) -> Column:
    """A double; null for what is no finite number."""
    x = c.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def sign_category(delta: Column, tolerance: float = 1e-12) -> Column:
    return F.when(delta > tolerance, "improved").when(delta < -tolerance, "worsened").otherwise("tied")


def canonical_sort(df: DataFrame) -> DataFrame:
    return df.orderBy("subject", "session", "run", "trial_id", "trial_uid")


def folds(trials: DataFrame, n_splits: int, seed: int, key: list[tuple[str, str]], strata: list[str] = ["subject", "class_label"]) -> DataFrame:
    """Adds fold: trials of a stratum in order of their digests, dealt round robin; ``key`` has (column, type name)."""
    rows = trials.withColumn("f_digest", typed_digest(seed, [(F.col(c), kind) for c, kind in key]))
    rows = running_number(rows, strata, ["f_digest", *[c for c, _ in key]], F.substring("f_digest", 1, _SPACE_KEY), "f_rank")
    return rows.withColumn("fold", F.pmod(F.col("f_rank") - 1, F.lit(n_splits)).cast("long")).drop("f_digest", "f_rank")


def small_strata(trials: DataFrame, n_splits: int, strata: list[str] = ["subject", "class_label"]) -> DataFrame:
    """Strata with fewer trials than folds; must be empty."""
    return trials.groupBy(*strata).count().where(F.col("count") < n_splits)


def pair_top_k(uids: DataFrame, k: int = 64, seed: int = SEED, subject: str = "subject", uid: str = "trial_uid") -> DataFrame:
    """The k unordered pairs of each subject whose digests are smallest, ranked."""
    a = uids.select(F.col(subject).alias("subject"), F.col(uid).cast("string").alias("uid_left"))
    b = uids.select(F.col(subject).alias("p_subject"), F.col(uid).cast("string").alias("uid_right"))
    pairs = a.join(b, (F.col("subject") == F.col("p_subject")) & (F.col("uid_left") < F.col("uid_right"))).drop("p_subject")
    pairs = pairs.withColumn("digest", pair_digest(seed, F.col("subject"), F.col("uid_left"), F.col("uid_right")))
    rank = F.row_number().over(W.partitionBy("subject").orderBy("digest", "uid_left", "uid_right"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def balanced_subset(trials: DataFrame, max_trials: int, seed: int = SEED, strata: list[str] = ["subject", "class_label"], uid: str = "trial_uid") -> DataFrame:
    """About max_trials trials, equally many of each stratum, the remainder to the first strata; smallest digests first."""
    names = trials.select(*strata).distinct()
    total = names.count()
    base, extra = divmod(max_trials, total)
    place = names.withColumn("b_place", F.row_number().over(W.orderBy(*strata)))  # one row per stratum
    rows = trials.join(F.broadcast(place), strata).withColumn("b_digest", tagged_digest(seed, "silhouette", F.col(uid)))
    rank = F.row_number().over(W.partitionBy(*strata).orderBy("b_digest", uid))
    take = F.lit(base) + (F.col("b_place") <= extra).cast("int")
    return rows.withColumn("b_rank", rank).where(F.col("b_rank") <= take).drop("b_place", "b_digest", "b_rank")


def first_by(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """``value`` at the smallest ``key`` of each group."""
    return df.groupBy(*by).agg(F.min(key).alias(key), F.min_by(value, key).alias(value))
