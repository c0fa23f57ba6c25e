import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridwork import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TMPDIR", tempfile.mkdtemp(prefix="gridwork-tests-"))
    s = get_session(master="local[*]", shuffle_partitions=8, app_name="gridwork-tests")
    yield s
    s.stop()
