"""Small document tables: nulls, empties, ties, repeats, clashing columns."""

from __future__ import annotations

import pytest

from wayfare.llm.shipping import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """``documents(texts, **columns)``: doc_ids from 0, or pairs (doc_id, text); further literal columns by name."""
    ship_package(spark)

    def build(texts, **extra):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, "en", f"src{(i or 0) % 2}", len(t or "")) for i, t in rows]
        from pyspark.sql import functions as F

        return spark.createDataFrame(full, SCHEMA).repartition(3, "doc_id").withColumns({k: F.lit(v) for k, v in extra.items()})

    return build


ODD = [None, "", "  \n\t ", "one", "two words", "a\x0bb\x0cc", "é à ü", "12 34", "\n\n", "x" * 5000]
CLASHING = {"shard": 1, "slot": 2, "n": 3, "class": 4, "row": 5, "words": "w", "score": 0.5, "key": 6, "host": "h"}
