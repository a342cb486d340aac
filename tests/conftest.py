import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    s = get_spark("local[4]", app="tessera-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    # a fresh folder per test; never shared or cleaned by pattern
    return tempfile.mkdtemp(prefix="tessera-test-")
