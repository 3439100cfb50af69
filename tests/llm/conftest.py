import pytest

from checks.compare import connect


@pytest.fixture(scope="session")
def llm_con(folder):
    return connect(folder)
