import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from boxloom.session import local_session

    session = local_session("4", "boxloom-tests", "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("BOXLOOM_TEST_DIR", "/root/testdata/sf0.001")
