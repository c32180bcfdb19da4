"""Each query that SQL can express against DuckDB, the others for their rows."""

import math

import duckdb
import pytest

import __spark_entry__
from covarium.plans import catalog
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["r46_cov4_log_svec", "r48_karcher_centers", "r49_airm_transform_isometry", "r50_domain_shift", "r53_mdm_airm", "r54_pca_variance", "r58_geometry_gate", "r59_mean_comparison"])
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_roundtrips_hold(spark):
    assert catalog.r47_spd_exp_invsqrt_roundtrip(spark, DATA).where("not roundtrip_ok or not whitening_ok").count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_without_optional_parts():
    """Nothing outside imports the optional subpackage."""
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent
    for p in (root / "covarium").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "covarium.llm" not in p.read_text(encoding="utf-8"), p
