import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cartwheel.session import checkpoint_dir, local_session
    s = local_session("4", shuffle_partitions=4, app="cartwheel-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


def ts(*a):
    return dt.datetime(*a)
