import pytest

from strataweave.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return ship_package(session)
