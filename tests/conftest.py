from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from treeloom.runtime import local_session

    session = local_session("tests", cpus="8", partitions="4", memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canon(frame):
    """A pandas frame with sorted columns and rows, floats rounded, as text."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(9)
        if frame[c].dtype.kind == "M":
            frame[c] = frame[c].astype("datetime64[us]")
    return frame.astype(str).sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql, d=SMALL):
        ours, theirs = query(spark, d).toPandas(), duck.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        a, b = canon(ours), canon(theirs)
        assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head(5).to_string()

    return check
