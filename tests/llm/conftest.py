import datetime
import decimal
import os

import duckdb
import pandas as pd
import pytest


@pytest.fixture(scope="session")
def duck():
    """Runs a DuckDB statement over the Parquet tables of a folder, or over
    given pandas tables."""
    def run(sql, sf_dir=None, **tables):
        with duckdb.connect() as con:
            for name in os.listdir(sf_dir) if sf_dir else ():
                con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
            for name, table in tables.items():
                con.register(name, table)
            return con.execute(sql).df()
    return run


def _plain(x):
    if pd.isna(x):
        return None
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x.item() if hasattr(x, "item") else x


@pytest.fixture(scope="session")
def same():
    """Whether two pandas tables hold the same rows, columns by name."""
    def check(got, want):
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        rows = lambda t: sorted((tuple(map(_plain, r)) for r in t[names].astype(object).values), key=repr)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                assert u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float))
                                  and u == pytest.approx(v, rel=1e-12)), (x, y)
    return check
