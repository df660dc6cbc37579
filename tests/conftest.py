from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestrata.session import local_session
    from lodestrata.tables import share_package

    session = local_session(4, "tests", **{"spark.driver.memory": "4g"})
    share_package(session)
    return session


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
