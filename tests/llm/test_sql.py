"""Queries against their DuckDB SQL at sf0.001."""

import duckdb
import pytest

from quern.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    flat = [tuple("none" if v != v or v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False)]
    return sorted(flat), list(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = QUERIES[name](spark, SF).toPandas(), db.sql(ORACLES[name]).df()
    whole = [c for c in mine.columns if c == "refers_to"]
    for df in (mine, theirs):
        df[whole] = df[whole].astype(float)
    assert rows(mine) == rows(theirs)
