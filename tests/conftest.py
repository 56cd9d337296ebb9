import pytest

from tidemark.session import local


@pytest.fixture(scope="session")
def spark():
    return local(4, "3g", 4)
