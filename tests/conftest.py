import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from penprint.session import build_session, checkpoint_dir
    s = build_session("local[4]", app="penprint-tests", shuffle_partitions=4)
    # Tests own their checkpoint folder only when the session names none.
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="penprint-chk-"))
    yield s
    s.stop()


def one(spark, expr, value, schema="t string"):
    """Evaluate a Column expression on a one-row frame holding ``value`` in column ``t``."""
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]
