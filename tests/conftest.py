"""Shared fixtures: one local Spark session and the canonical tables."""

from __future__ import annotations

import os
import sys
import tempfile

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from branchwise.session import build_local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BRANCHWISE_TMP", tempfile.mkdtemp(prefix="bw-tests-", dir="/tmp"))
    s = build_local_session("*", shuffle_partitions=8, app_name="branchwise-tests")
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from branchwise.sources.store import open_tables
    return open_tables(spark, SF001)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def duck001():
    return duck(SF001)
