import pytest

from fathomline.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "fathomline-tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.enabled": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
