"""Fixtures of the text operator tests."""

import pytest

from tradeledger.llm.common import importable

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    return importable(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return lambda rows: spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], DOCUMENTS)
