import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pumpline.session import local_session

    made = local_session("local[4]", shuffle_partitions=4, warehouse=str(tmp_path_factory.mktemp("warehouse")))
    yield made
    made.stop()
