import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from colscope.session import build_session, clear_scratch

    s = build_session(os.environ.get("TEST_CPUS", "8"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
