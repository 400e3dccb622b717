"""Documents for the tests of the text operators."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from {id: text} or from (id, text) pairs."""

    def rows(texts, langs=None):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        langs = langs or {}
        return spark.createDataFrame([(i, t, langs.get(i), "s", len(t or "")) for i, t in pairs], DOCS)

    return rows
