from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from marquee.session import get_spark

    session = get_spark("local[*]", app="marquee-tests", conf={
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    })
    session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="marquee-test-ckpt-"))
    yield session


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="marquee-test-")
