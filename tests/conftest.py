import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from twin import spark_session

    session = spark_session()
    yield session
    session.stop()


@pytest.fixture
def big_input(monkeypatch):
    """Every group of five rows counts as hot."""
    from presage.operators import skew

    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 5)
