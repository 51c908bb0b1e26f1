import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import session

    found = session(4, "6g")
    found.sparkContext.setLogLevel("OFF")
    return found
