import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tabml.session import local_session
    session = local_session("tests", cores=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER
