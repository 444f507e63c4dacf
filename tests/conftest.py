import pytest

from veilspan.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(4, 4, "4g", shared=str(tmp_path_factory.mktemp("shared")))
