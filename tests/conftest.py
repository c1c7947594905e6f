import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from matchgrid.session import build_session

    return build_session(8, "tests", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
