from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from sextant.session import session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(4, "tests", "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
