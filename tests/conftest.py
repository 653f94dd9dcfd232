import pytest

from poolsift.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=3, memory="4g")
