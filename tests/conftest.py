import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from flockwatch.session import session

    s = session(
        "tests",
        f"local[{os.environ.get('TEST_CPUS', '4')}]",
        **{"spark.sql.shuffle.partitions": "6", "spark.ui.enabled": "false", "spark.driver.memory": "3g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
