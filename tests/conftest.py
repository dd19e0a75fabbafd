import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from loadshape import schemas as S  # noqa: E402
from loadshape.session import ensure_checkpoint_dir  # noqa: E402
from study_values import d, ts  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[2]").appName("loadshape-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture
def meter_df(spark):
    """Build a canonical meter DataFrame from (id, 'YYYY-MM-DD HH:MM', kWh) tuples."""
    def make(rows):
        data = [(i, ts(t), ts(t).date(), v) for i, t, v in rows]
        return spark.createDataFrame(data, schema=S.METER_SCHEMA)
    return make


@pytest.fixture
def tariff_df(spark):
    def make(rows):
        return spark.createDataFrame([(i, d(s) if s else None, p) for i, s, p in rows],
                                     schema=S.TARIFF_SCHEMA)
    return make
