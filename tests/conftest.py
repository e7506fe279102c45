import pytest

from mnestra.session import local_session, release


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": "/tmp/mnestra-warehouse"})
    yield session
    release(session)
