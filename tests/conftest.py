import os

os.environ.setdefault("TALUS_DRIVER_MEMORY", "4g")

import pytest

from talus.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus="4", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
