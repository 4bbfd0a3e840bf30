import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    # Show the whole ReadSchema in plans.
    session.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield session
    session.stop()
