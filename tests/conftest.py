import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def table(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(_plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def same_rows(spark):
    """Checks that a query and its SQL give the same rows over a folder, or over given documents."""
    import duckdb

    def check(query, sql, data=DATA, documents=None):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for path in Path(data).glob("*.parquet"):
            con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        if documents is not None:
            arrow = documents.toArrow()
            con.register("given", arrow)
            con.sql("CREATE OR REPLACE VIEW documents AS SELECT * FROM given")
        got = query(spark, data) if callable(query) else query
        want = con.sql(sql)
        assert table(got.collect(), got.columns) == table(want.fetchall(), want.columns)

    return check
