"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from wavefix.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect(config={"memory_limit": "4GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v != v:
            return "-"
        return f"{float(v) + 0.0:.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(map(tuple, df[sorted(df.columns)].map(one).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), sql.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_is_known():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
