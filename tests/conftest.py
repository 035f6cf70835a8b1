from __future__ import annotations

import pytest

from ledgerfold.session import session


@pytest.fixture(scope="session")
def spark():
    made = session("tests", "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
