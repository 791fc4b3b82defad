import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from strandline.session import get_session
    session = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.sql.files.maxPartitionBytes": "32m"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
