import pytest

from tests.support import spark_session


@pytest.fixture(scope="session")
def spark():
    return spark_session()
