import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tailsplit.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("scratch")
    session = get_session("local[4]", "tests", shuffle_partitions=4, driver_memory="6g",
                          spark__checkpoint__dir=str(shared))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
