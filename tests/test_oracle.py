"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

from pepspark.plans import registry

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return float(f"{float(x):.9g}")
    return x


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(value, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    other = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(other.columns)
    theirs = sorted((tuple(map(value, r)) for r in other.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert ours == theirs


def test_others_have_tests():
    """Queries without SQL are held against NumPy or plain loops in test_numeric."""
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"src14_isotope_patterns", "dom14_match_clusters", "dom19_protein_inference", "dom20_logistic_scorer", "dom21b_calibration_bounds", "dom22_alignment", "dom28_max_lfq"}
