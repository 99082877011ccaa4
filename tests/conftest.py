import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """SQL over the driver's tables of one size, as a function (sql, size) -> (columns, rows)."""
    duckdb = pytest.importorskip("duckdb")
    opened = {}

    def run(sql, size="sf0.001"):
        if size not in opened:
            opened[size] = duckdb.connect()
            for p in (Path("/root/testdata") / size).glob("*.parquet"):
                opened[size].execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
        found = opened[size].execute(sql)
        return [c[0] for c in found.description], found.fetchall()

    return run
