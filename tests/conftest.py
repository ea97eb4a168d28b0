import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyforge.session import local_session

    session = local_session(os.environ.get("TEST_CPUS", "4"), "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables; tests that need them are skipped elsewhere."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no driver tables here")
    return folder
