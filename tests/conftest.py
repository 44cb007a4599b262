from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gneiss.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir("file://" + str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()
