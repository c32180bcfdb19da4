"""Result tables for figures, long summaries and Markdown reports.

Reports are small by nature (a row per subject, geometry and split), so they are
rendered on the driver from tables that are already aggregated.
"""

from __future__ import annotations

import math
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.operators import verdicts
from covarium.operators.contracts import ContractError, require_columns
from covarium.operators.trials import canonical_metric, canonical_representation, canonical_target, finite_or_null
from covarium.sources import sinks

#: Most rows that a report table may have.
REPORT_ROWS = 10_000
#: Sections of the geometry report, in order.  Fixed values.
SECTIONS = (
    "Motivation", "Frozen protocol", "Geometry definitions", "Geometry correctness", "LE vs AIRM Fréchet means", "V1 leakage audit", "LOSO transductive results",
    "Calibration-to-held-out-run results", "Metric-native MDM sanity check", "Marginal domain diagnostics", "Frozen decision-rule verdicts", "What is actually justified",
    "What is NOT justified", "Single recommended next experiment",
)


def separability_scores(rows: DataFrame) -> DataFrame:
    """Free-form separability rows (representation, state, metric, window, value) as (representation, metric, window, value)."""
    require_columns(rows, ["representation", "state", "metric", "value"])
    window = F.coalesce(F.col("window").cast("string"), F.lit("all")) if "window" in rows.columns else F.lit("all")
    out = rows.select(canonical_representation(F.col("representation"), F.col("state")).alias("representation"), canonical_metric(F.col("metric")).alias("metric"), window.alias("window"), finite_or_null(F.col("value")).alias("value"))
    return out.where("metric is not null")


def probe_scores(rows: DataFrame) -> DataFrame:
    """Free-form probe rows (representation, state, target, accuracy, chance) with canonical names."""
    require_columns(rows, ["representation", "state", "target", "accuracy", "chance"])
    return rows.select(canonical_representation(F.col("representation"), F.col("state")).alias("representation"), canonical_target(F.col("target")).alias("target"), finite_or_null(F.col("accuracy")).alias("accuracy"), finite_or_null(F.col("chance")).alias("chance"))


def wide_scores(scores: DataFrame, by: str, column: str, value: str, names: list[str]) -> DataFrame:
    return scores.groupBy(by).pivot(column, names).agg(F.first(value))


def long_summary(blocks: dict[str, DataFrame]) -> DataFrame:
    """Blocks of different columns in one long table; absent columns are null."""
    named = [df.withColumn("block", F.lit(name)) for name, df in blocks.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def figure_sources(results: DataFrame, means: DataFrame, leakage: DataFrame) -> dict[str, DataFrame]:
    """The five tables behind the figures; drawing is left to the reader's tools."""
    t1, t2 = verdicts.ba_pivot(results, "ALL", subject="target"), verdicts.ba_pivot(results, "AGGREGATE", subject="target")
    named = lambda df, p: df.select("target", *[F.col(g).alias(f"{p}_{g}") for g in ("RAW", "LE", "AIRM", "EA")])
    return {
        "figure_1_loso_ba_by_subject": t1, "figure_2_paired_delta_vs_raw": verdicts.subject_deltas(t1, "target"),
        "figure_3_t1_vs_t2_ba": named(t1, "t1").join(named(t2, "t2"), "target"), "figure_4_le_vs_airm_centers": means, "figure_5_v1_leakage_audit": leakage,
    }


def number(x, digits: int = 4) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "n/a"
    return f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A Markdown table; an error for tables that are no report tables."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ContractError(f"a report table has at most {REPORT_ROWS} rows")
    cell = lambda v: number(v, digits).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def render(title: str, sections: dict[str, str], required: tuple[str, ...] = SECTIONS) -> str:
    """A report with exactly the required sections, in their order."""
    if set(sections) != set(required):
        raise ContractError(f"sections differ: {sorted(set(sections) ^ set(required))}")
    parts = [f"# {title}", *[f"## {i}. {name}\n\n{sections[name].strip()}" for i, name in enumerate(required, 1)]]
    text = "\n\n".join(parts) + "\n"
    found = [line.split(". ", 1)[1] for line in text.splitlines() if line.startswith("## ")]
    if found != list(required):
        raise ContractError("a section's text holds a heading of its own")
    return text


def write(out: str | Path, report: str, tables: dict[str, DataFrame]) -> list[str]:
    """Tables as CSV folders and the report beside them; the names that were written."""
    for name, df in tables.items():
        sinks.csv(df, str(sinks.inside(out, name)), mode="overwrite")
    sinks.text(sinks.inside(out, "report.md"), report)
    return [*tables, "report.md"]
