import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session
    from faultline.plans.staging import tune

    s = session("4")
    s.sparkContext.setLogLevel("ERROR")
    tune(s)
    yield s
    s.stop()
