import pytest

from paperfold.sources.shared import discard
from tests.oracle import DATA, duck, make_spark


@pytest.fixture(scope="session")
def spark():
    session = make_spark()
    yield session
    discard(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA / "sf0.001"


@pytest.fixture(scope="session")
def con(folder):
    return duck(folder)
