import pytest

from tidewatch.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(memory="6g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()
