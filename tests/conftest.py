from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from crosspanel.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "crosspanel-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def month(index: int) -> dt.date:
    """Month end number ``index`` counted from January 2020 (0)."""
    year, m = 2020 + index // 12, index % 12 + 1
    nxt = dt.date(year + (m == 12), m % 12 + 1, 1)
    return nxt - dt.timedelta(days=1)
