import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from bandwise.session import get_session

    # the checkpoint folder is read from the session; checkpoint_dir() sets a scratch one only
    # when spark.checkpoint.dir is unset
    s = get_session("local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield s
