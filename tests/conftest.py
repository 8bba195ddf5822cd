import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from shoal.session import get_spark

    s = get_spark(4, shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def rows():
    """A DataFrame's rows as sorted tuples, in the given order of columns."""

    def get(df, *columns):
        return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))

    return get
