import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quern.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4, 4)
    session.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", "4")
    yield session
    session.stop()
