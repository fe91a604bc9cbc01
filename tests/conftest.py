import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='cellquill-tests-')}", "spark.default.parallelism": "4",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same_rows(got, expected) -> None:
    """Equal pandas tables, in any order of rows and columns."""
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    got, expected = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expected))
    assert len(got) == len(expected)
    for c in columns:
        null = got[c].isna().to_numpy()
        assert (null == expected[c].isna().to_numpy()).all(), c
        assert (got[c].to_numpy()[~null] == expected[c].to_numpy()[~null]).all(), c
