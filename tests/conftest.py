import pytest

from shardloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(4, "tests", **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")), "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()
