import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return list(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not (n.startswith("op") and n[2].isdigit()) and n != "pipeline"))
def test_query_agrees_with_its_sql(spark, sf, oracle, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    if name in entry.oracle_sql():
        rel = oracle.sql(entry.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
    else:
        assert got
