"""Every query with SQL gives DuckDB's rows; of every other one only that it runs is tested here, its operators are in the other files."""

import duckdb
import pandas as pd
import pytest

from papershed.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    def plain(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    expect = duck.sql(registry.ORACLE_SQL[name]).df()
    assert columns == sorted(expect.columns)
    assert rows(found.select(columns).toPandas(), columns) == rows(expect, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_entry_without_the_training_data_operators(spark):
    import subprocess
    import sys
    from pathlib import Path

    code = "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n in ('papershed.llm', 'corpus_pipeline') else f(n, *a); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))]
