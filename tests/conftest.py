import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tradeledger.session import tune  # noqa: E402
from tradeledger import schema  # noqa: E402
from tradeledger.sources.tables import Tables  # noqa: E402
from tradeledger.sources.text import load_table_tsv  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def seed(spark):
    """The small book of fixed rows in ``tests/seed``."""
    folder = ROOT / "tests" / "seed"
    return Tables({n: (lambda n=n: load_table_tsv(spark, str(folder / f"{n}.tsv"), n)) for n in schema.DDL})


def same(left, right):
    """Both frames hold the same rows, column order aside."""
    assert sorted(left.columns) == sorted(right.columns)
    columns = sorted(left.columns)
    a = sorted(map(str, left.select(*columns).collect()))
    b = sorted(map(str, right.select(*columns).collect()))
    assert a == b
    return len(a)
