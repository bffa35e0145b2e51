import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newsgrain.session import build_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
