import pytest

from propspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cores=4, shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
