import os

import pytest

from scenara.session import build_session

SF_ROOT = os.environ.get("TEST_SF_ROOT", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = f"{SF_ROOT}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no star-schema tables")
    return path


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples of the named columns."""

    def collect(df, *cols):
        got = [tuple(r[c] for c in cols) for r in df.collect()]
        return sorted(got, key=lambda r: [(v is not None, str(type(v)), v if v is not None else 0) for v in r])

    return collect
