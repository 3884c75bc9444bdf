"""Every registered query of the core against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from quillmesh.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(str(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_needs_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "quillmesh"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "quillmesh.llm" not in f.read_text(), f
