import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__  # noqa: E402, F401 - registers the package for the workers
from quoteloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)
