import pytest

import __spark_entry__ as driver
from tests.compare import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    driver._ship_package(session)
    return session
