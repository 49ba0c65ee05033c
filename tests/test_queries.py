"""Registered queries against their reference SQL (a spread by default, all with BOXLOOM_ALL=1)."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SPREAD = [
    "ag2", "ag3", "ag14", "box16", "dq1", "gr3", "jn4", "jn7", "mt2", "mt5", "mt8", "set5", "sp2", "sp3", "src1", "st2", "st6",
    "vw7", "wn4", "ag15", "dq1_content", "dq2_near", "gr2_faults", "hsh2", "jn9", "sp6", "src4", "vw1_roi", "vw3", "wn7",
]


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def keys():
    return sorted(entry.oracle_sql()) if os.environ.get("BOXLOOM_ALL") else SPREAD


@pytest.mark.parametrize("key", keys())
def test_query_equals_sql(spark, folder, con, key):
    n, problem = compare(entry.queries()[key](spark, folder), entry.oracle_sql()[key], con)
    assert problem is None


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Tables of vectors whose values lie on the edge of a shade, where double precision tells otherwise, and of parts with long keys."""
    import duckdb
    import numpy as np

    x = np.arange(-0.3, 0.3, 1e-3, dtype=np.float64).astype(np.float32)
    turns = [np.floor(x * np.float32(a) + np.float32(b)) != np.floor(x.astype(np.float64) * a + b) for a, b in ((400, 128), (100, 0))]
    assert all(t.any() for t in turns)
    at = np.concatenate([x[t] for t in turns])
    place = tmp_path_factory.mktemp("edges")
    db = duckdb.connect()
    db.execute("CREATE TABLE e (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    for i in range(6):
        db.execute("INSERT INTO e VALUES (?, ?, ?)", [i * 7, np.resize(np.roll(at, i), 64).tolist(), i % 2])
    db.execute(f"COPY e TO '{place}/embeddings.parquet' (FORMAT parquet)")
    db.execute(f"COPY (SELECT k AS p_partkey, 3 AS p_size FROM (VALUES (120000), (1200000), (1200001), (7)) v(k)) TO '{place}/part.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{place}/embeddings.parquet'; CREATE VIEW part AS SELECT * FROM '{place}/part.parquet'")
    return str(place), db


@pytest.mark.parametrize("key", ["src7", "src8", "hsh1", "hsh2", "hsh3", "ag26", "jn10", "src5"])
def test_query_equals_sql_on_edges(spark, edges, key):
    n, problem = compare(entry.queries()[key](spark, edges[0]), entry.oracle_sql()[key], edges[1])
    assert problem is None and n


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
