import pytest

from paylens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    df = df.select(*[f"`{c}`" for c in columns]) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=repr)
