import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from talentmesh.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app_name="talentmesh-tests")
    s.sparkContext.setLogLevel("ERROR")
    from talentmesh.session import ship_package

    ship_package(s)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tm-test-ckpt-"))
    yield s
    s.stop()
