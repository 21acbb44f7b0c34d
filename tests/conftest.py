from __future__ import annotations

import pytest

from panelspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 8, 8)
    s.sparkContext.setLogLevel("OFF")
    return s
