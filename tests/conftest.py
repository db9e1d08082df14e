import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tools.check_oracles import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(int(os.environ.get("TEST_CPUS", "8")))


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
