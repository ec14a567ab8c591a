import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shoreline.session import checkpoint_dir, local_session

    s = local_session(cores=4, shuffle_partitions=8, app="shoreline-tests")
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s, default=tempfile.mkdtemp(prefix="shoreline-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="shoreline-test-")
