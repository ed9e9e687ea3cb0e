"""Every registered monitoring query that has SQL gives the same rows; batch and stream agree."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import rows_of

from tidegauge.plans.oracles import ORACLES
from tidegauge.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return db


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    cur = db.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_need_the_llm_subpackage():
    root = Path(__file__).parents[1] / "tidegauge"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "tidegauge.llm" not in f.read_text(), f
