import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from usageloom.session import build_session

    return build_session(8, 4)
