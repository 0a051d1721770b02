from __future__ import annotations

import pytest

from tickloom.llm.common import prepare

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, start string, length int"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang]) as a table of documents with two more columns whose names clash."""
    prepare(spark)

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or ""), "x", 1) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build
