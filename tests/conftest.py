import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from mascate.session import local_session  # noqa: E402
from mascate.sources.tables import schema_of  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """Build a report table from dicts; columns not given are NULL."""

    def build(table, rows):
        schema = schema_of(table)
        data = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
        return spark.createDataFrame(data, schema)

    return build


def rows(df, *columns):
    """Rows as a sorted list of tuples, without regard to row order."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
