import os

import pytest

from vellum.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "4"), "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
