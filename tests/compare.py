"""Compare a query's rows with those of its SQL."""

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return str(v)[:10] if hasattr(v, "year") else str(v)


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        try:
            df[c] = df[c].astype(float).round(6)
        except (TypeError, ValueError):
            df[c] = df[c].map(_plain)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], rtol=1e-6, atol=1e-6, equal_nan=True), c
        else:
            assert a[c].fillna("\0").tolist() == b[c].fillna("\0").tolist(), c
