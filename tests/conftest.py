import os
import sys

import pytest

HERE = os.path.dirname(__file__)
sys.path[:0] = [os.path.dirname(HERE), HERE]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from hearthline.session import local_session, prepare

    session = prepare(local_session("8", shuffle_partitions=4))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import compare

    return compare.connect(sf_dir)
