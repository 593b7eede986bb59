from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts (ids by place) or (id, text) pairs."""

    def make(texts, extra: str | None = None):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
        # Columns with names that operators might use themselves.
        return df.selectExpr("*", "'x' AS gone", "1 AS _row", "'k' AS kept", "0 AS length", "'y' AS cid") if extra else df

    return make
