import pytest

from gleanery.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("8", "tests", 4)
