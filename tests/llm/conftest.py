from __future__ import annotations

import pytest
from conftest_llm import EDGE_TEXTS


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column but the id, clashing column names, repeated texts, a very long text."""
    rows = [
        (i, t, None, "x" if i % 2 else None, None if i % 3 else i, i * 1.5, None)
        for i, t in enumerate(EDGE_TEXTS)
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, score string, n_tokens long, rep double, key string"
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
