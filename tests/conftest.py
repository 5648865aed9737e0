import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    """Rows as comparable text, in order."""

    def one(v):
        if v is None or v != v:
            return "-"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "tzinfo"):
            return v.replace(tzinfo=None).isoformat()
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def same(spark, duck, data):
    def check(query, sql):
        got, want = query(spark, data), duck.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert plain(got.select(*sorted(names)).collect()) == plain([r[i] for i in sorted(range(len(names)), key=names.__getitem__)] for r in want.fetchall())

    return check
