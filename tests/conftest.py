from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagefleet.session import get_spark

    s = get_spark(master="local[8]", shuffle_partitions=8)
    yield s


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
