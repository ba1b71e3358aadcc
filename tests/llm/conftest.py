import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, or rows with more columns."""
    from hexlens.llm.common import prepare
    prepare(spark)

    def make(rows, lang="en"):
        full = [(i, t, *(rest or [lang, "s", None if t is None else len(t)])) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)
    return make


@pytest.fixture(scope="session")
def prose():
    """n words of made-up prose, the same for a seed."""
    import random

    def make(seed, n, vocabulary=5000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
    return make
