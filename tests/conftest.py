import pytest

from runlens import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("runlens-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
