"""Small documents with the cases that every operator has to bear."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_samples import SCHEMA, prose  # noqa: E402

@pytest.fixture
def documents(spark):
    """Makes documents from texts, or from (id, text) pairs."""

    def make(*texts):
        rows = [(t[0], t[1]) if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture
def awkward(documents):
    """Null, empty and blank texts, ties, repeated rows, a null id, zero bytes, letters beyond ASCII and a long text."""
    rng = random.Random(1)
    long = prose(rng, 3000)
    base = prose(rng, 60)
    return documents(
        (0, None), (1, ""), (2, " \n\t "), (3, base), (4, base), (5, base), (5, base), (6, base[:200] + " other words " + base[200:]), (7, "ñandú été 漢字 \x00 x " * 20), (8, long), (9, long + " end"), (None, "no id here"), (10, "a " * 50), (11, "x" * 500),
    )


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
