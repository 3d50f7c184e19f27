import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from promospark.session import get_spark, tune
    ckpt = tempfile.mkdtemp(prefix="promospark-test-ckpt-")
    s = get_spark("local[4]", shuffle_partitions=4, extra={"spark.checkpoint.dir": ckpt})
    tune(s)
    yield s
    s.stop()


def one(spark, col, value, schema="s STRING"):
    """Evaluate a Column function on a single literal row."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col).first()[0]
