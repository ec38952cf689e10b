import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from tilewright.session import local_session

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
