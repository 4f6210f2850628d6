import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import get_spark

    scratch = tempfile.mkdtemp(prefix="ledgerlens-test-")
    s = get_spark(
        "ledgerlens-tests", master="local[4]", shuffle_partitions=4,
        extra={"spark.local.dir": scratch, "spark.checkpoint.dir": os.path.join(scratch, "ckpt")},
    )
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="ledgerlens-t-")
