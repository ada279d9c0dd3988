import pytest

from quarry.llm import near_duplicates


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    """Small tables need no more tasks than the session has."""
    monkeypatch.setattr(near_duplicates, "TASKS", 4)
