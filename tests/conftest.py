import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tomeglass.session import local_session, ship_package  # noqa: E402

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tomeglass-tests", memory="8g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    from tomeglass.plans.derived import corpus

    return corpus(spark, TINY)


@pytest.fixture
def no_broadcast(monkeypatch):
    """Take every side for too large to broadcast."""
    from tomeglass.functions import joins
    from tomeglass.operators import documents, lexical

    for module in (joins, documents, lexical):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)


def rows(df, *order):
    """The rows of ``df`` as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r)) if not order else [
        tuple(r) for r in df.orderBy(*order).collect()
    ]
