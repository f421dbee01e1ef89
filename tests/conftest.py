import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from oracle_check import session

    s = session()
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from oracle_check import connect

    return connect(SF_CHECK)
