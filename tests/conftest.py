import pytest

from quarry.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=8, shuffle_partitions=8)
    yield s
    s.stop()
