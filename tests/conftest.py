import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from freshet.session import local_session, shared_folder


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def folder(spark):
    """A new folder below the shared one; the setting may outlive a test run."""
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"
