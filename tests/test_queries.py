"""Every query of the catalog against its DuckDB form, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella import registry
from tessella.plans.relations import SQL, TABLES, Relations

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer, float, np.floating, decimal.Decimal)):
        return None if v != v else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:19]
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_relation_agrees_with_sql(spark, duck, name):
    from tessella.plans.relations import with_relations

    assert rows(getattr(Relations(spark, DATA), name).toPandas()) == rows(duck.sql(with_relations(f"SELECT * FROM {name}")).df())


def test_names_match_between_catalog_and_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_without_the_llm_folders(tmp_path):
    """The entry and the rest import and list their queries when the subpackage is gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in glob.glob(f"{root}/*"):
        if os.path.basename(p) in ("tessella", "__spark_entry__.py"):
            (shutil.copytree if os.path.isdir(p) else shutil.copy)(p, tmp_path / os.path.basename(p))
    shutil.rmtree(tmp_path / "tessella" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'ranked_search' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
