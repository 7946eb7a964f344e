import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cordwood.session import local_session

    s = local_session("4", 2, "4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


DATA = Path("/root/testdata/sf0.001")
