import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillstone.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test data")
    return SF
