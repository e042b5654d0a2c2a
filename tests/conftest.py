import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docloom.session import local_session, ship

    import os

    os.environ.setdefault("DOCLOOM_DRIVER_MEMORY", "4g")
    s = local_session("docloom-tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return ship(s)
