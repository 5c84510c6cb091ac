"""Every query of the reference's operators against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from frameweft.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
