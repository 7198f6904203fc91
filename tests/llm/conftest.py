import pytest

from strataweave.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)
