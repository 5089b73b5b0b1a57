import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from evenkeel.session import session

    s = session("tests", cpus="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
