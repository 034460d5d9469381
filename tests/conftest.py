import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flagloom.session import get_spark, use_local_checkpoints

    s = get_spark("local[*]", shuffle_partitions=8, app="flagloom-tests")
    use_local_checkpoints(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from oracle_compare import duck

    return duck(SF_SMALL)
