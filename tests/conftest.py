import pytest

from readq.session import clear_shared, local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests", partitions=4, memory="4g")
    yield s
    clear_shared(s)
    s.stop()
