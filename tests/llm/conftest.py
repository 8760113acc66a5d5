import pytest


@pytest.fixture
def scratch(spark):
    from foliant.llm.work import Scratch

    s = Scratch(spark, "test")
    yield s
    s.drop()
