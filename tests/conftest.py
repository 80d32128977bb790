import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from lumenfold.session import local_session

    s = local_session(cores=4, shuffle_partitions=2, memory="3g")
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    from lumenfold.session import Scratch

    return Scratch(spark, "test")
