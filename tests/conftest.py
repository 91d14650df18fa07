import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from rivetgraph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("rivetgraph-tests", 8, **{"spark__sql__shuffle__partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make(rows, ddl) → DataFrame."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


def rows_of(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
