"""Contracts as queries: each returns the violations, or one row per check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"columns are missing: {missing}")


def require_empty(violations: DataFrame, what: str) -> None:
    """An error that shows at most five violations."""
    found = violations.limit(5).collect()
    if found:
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def functional_violations(df: DataFrame, key: list[str], dependent: str) -> DataFrame:
    """Keys with more than one value of ``dependent``; null counts as a value."""
    value = F.struct(F.col(dependent).alias("v"))
    return df.groupBy(*key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def incomplete_windows(df: DataFrame, key: list[str], n_windows: int = 5, window: str = "window_index") -> DataFrame:
    """Keys whose windows aren't 1..n once each."""
    got = F.sort_array(F.collect_list(F.col(window).cast("long")))
    want = F.array(*[F.lit(i).cast("long") for i in range(1, n_windows + 1)])
    return df.groupBy(*key).agg(got.alias("windows")).where(~F.col("windows").eqNullSafe(want))


def count_contract(df: DataFrame, by: list[str], expected: int | None = None) -> DataFrame:
    """Rows by group; with ``expected``, only the groups that have another number."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return out if expected is None else out.where(F.col("n") != expected)


def grid_difference(observed: DataFrame, dimensions: list[DataFrame], key: list[str]) -> DataFrame:
    """Expected keys (the product of small dimension tables) that are missing, and observed ones that are extra or repeat."""
    grid = reduce(lambda a, b: a.crossJoin(b), dimensions).select(*key)
    seen = observed.select(*key)
    missing = grid.join(seen.distinct(), key, "left_anti").withColumn("issue", F.lit("missing"))
    extra = seen.distinct().join(F.broadcast(grid), key, "left_anti").withColumn("issue", F.lit("extra"))
    repeated = duplicates(seen, key).drop("n").withColumn("issue", F.lit("duplicate"))
    return missing.unionByName(extra).unionByName(repeated)


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of a, b, intersection, union and both differences of two key sets, and whether they are equal or disjoint."""
    side = a.select(F.col(key).alias("k")).distinct().withColumn("a", F.lit(1)).unionByName(b.select(F.col(key).alias("k")).distinct().withColumn("b", F.lit(1)), allowMissingColumns=True)
    each = side.groupBy("k").agg(F.count("a").alias("a"), F.count("b").alias("b"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    ina, inb = F.col("a") > 0, F.col("b") > 0
    out = each.agg(n(ina).alias("n_a"), n(inb).alias("n_b"), n(ina & inb).alias("n_both"), F.count(F.lit(1)).alias("n_union"), n(ina & ~inb).alias("n_only_a"), n(inb & ~ina).alias("n_only_b"))
    return out.withColumn("equal", (F.col("n_only_a") == 0) & (F.col("n_only_b") == 0)).withColumn("disjoint", F.col("n_both") == 0)


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(check_name, violations, passed) of row rules that have to be true, from one pass over the table."""
    counted = df.agg(*[F.coalesce(F.sum((~F.coalesce(r, F.lit(False))).cast("long")), F.lit(0)).alias(k) for k, r in rules.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).cast("long").alias("violations")) for k in rules])
    return counted.select(F.inline(pairs)).withColumn("passed", F.col("violations") == 0)


def status_rules(metrics: list[str], status: str = "status") -> dict[str, Column]:
    """A passed row has all its metrics within [0, 1]; a failed row has none."""
    rules = {"status_known": F.col(status).isin("PASS", "FAILED")}
    for m in metrics:
        rules[f"{m}_null_iff_failed"] = F.col(m).isNull() == (F.col(status) == "FAILED")
        rules[f"{m}_in_range"] = F.col(m).isNull() | F.col(m).between(0.0, 1.0)
    return rules


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(check_name, violations, passed): provenance columns have one value, never null."""
    seen = df.agg(*[F.struct(F.countDistinct(c).alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("z")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(f"{c}_constant").alias("check_name"), (F.greatest(F.col(c)["n"] - 1, F.lit(0)) + F.coalesce(F.col(c)["z"], F.lit(0))).cast("long").alias("violations")) for c in columns])
    return seen.select(F.inline(pairs)).withColumn("passed", F.col("violations") == 0)


def compare(expected: DataFrame, observed: DataFrame, key: list[str], value: str) -> DataFrame:
    """A summary against its contract: key, expected, observed, passed; a key that only one side has fails."""
    want = expected.select(*[F.col(k).alias(f"w_{k}") for k in key], F.col(value).alias("expected"), F.lit(True).alias("w_there"))
    got = observed.select(*key, F.col(value).alias("observed"), F.lit(True).alias("o_there"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in key])
    met = got.join(want, same, "full")
    passed = F.col("w_there").isNotNull() & F.col("o_there").isNotNull() & F.col("expected").eqNullSafe(F.col("observed"))
    return met.select(*[F.coalesce(k, f"w_{k}").alias(k) for k in key], "expected", "observed", passed.alias("passed"))


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that either side holds once; an error otherwise."""
    for side, df in (("left", left), ("right", right)):
        require_empty(duplicates(df, [key]), f"{key} repeats on the {side}")
    return left.join(right, key)


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of their key in ``table``; an error, as the rows pass, where the table lacks it."""
    found = rows.join(table.select(key, F.col(value).alias("l_value")), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(table.schema[value].dataType)
    return found.withColumn(value, F.coalesce("l_value", missing)).drop("l_value")
