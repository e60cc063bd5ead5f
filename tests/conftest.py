import pytest

from tarnlight.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session("tests", 4, spark__driver__memory="4g", spark__sql__shuffle__partitions="4")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()
