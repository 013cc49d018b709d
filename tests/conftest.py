import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strataframe import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[8]", 4, **{"spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
