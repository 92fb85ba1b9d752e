"""One local session for all tests; the tables are read where they lie."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sieveline.session import local

    return local(4, "4g", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def con():
    from compare import oracle

    return oracle(SF)


@pytest.fixture(scope="session")
def small_con():
    from compare import oracle

    return oracle(SMALL)
