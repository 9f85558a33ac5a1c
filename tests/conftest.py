import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from framescope.session import local_session

    s = local_session("*", shuffle_partitions=8, app="framescope-tests")
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="framescope-test-")
