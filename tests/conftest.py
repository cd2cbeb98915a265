from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quarrymill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", cores="4", shuffle_partitions=4, driver_memory="4g", shared_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()
