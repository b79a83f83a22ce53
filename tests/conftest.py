import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

from skein.plans.session import local_session  # noqa: E402

SESSION = local_session(4, 4, "4g")  # columns in test modules need a running session


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
