import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the Python workers


@pytest.fixture(scope="session")
def spark():
    from quernel.session import local_session

    s = local_session("4", "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
