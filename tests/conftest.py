import pytest

from hushgate import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def strings(spark):
    """A one-column table of texts with their position."""
    def make(values, name="text"):
        return spark.createDataFrame(list(enumerate(values)), f"i int, {name} string").coalesce(2)
    return make
