"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(rows: list[dict]) -> list[str]:
    """Rows as sorted texts, floats to nine places."""
    show = lambda v: "None" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)
    return sorted("|".join(f"{k}={show(r[k])}" for k in sorted(r)) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on the small tables."""

    def check(query, sql: str) -> None:
        ours = [r.asDict() for r in query(spark, DATA).collect()]
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        theirs = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        assert normal(ours) == normal(theirs)

    return check
