from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from factsift.session import get_spark
    s = get_spark("local[4]", app="factsift-tests", shuffle_partitions=4,
                  extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="factsift-test-wh-")})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factsift-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF_SMALL = "/root/testdata/sf0.001"
