from __future__ import annotations

import pytest

from lodestone.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[2]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__default__parallelism=2)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
