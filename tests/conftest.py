import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from textvault.session import checkpoint_dir, get_spark
    s = get_spark("local[8]", 8)
    checkpoint_dir(s)
    yield s


def one(spark, expr_col, value, schema="x string"):
    """Evaluate a Column expression over a one-row frame holding ``value``."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_col.alias("r")).first()["r"]
