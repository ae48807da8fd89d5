"""Extra columns, some named like what operators add or use inside."""

import random

from llm_samples import prose
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.language import identify
from millrace.llm.mixing import mix
from millrace.llm.simhash import group
from millrace.llm.substrings import dedup_words
from millrace.llm.suffix_array import dedup_bytes
from millrace.llm.templates import drop_recurring
from millrace.llm.tokens import count_tokens, vocabulary_path

EXTRA = ("rate", "word", "bits", "numbers", "leaf", "spans", "m", "_id", "_h", "score", "kept", "topic", "n_lines", "component_id", "fingerprint", "n_words")


def runs(spark):
    """Each operator on documents, as a function that gives one row for each."""
    return {
        "mix": lambda d: mix(d, Scratch(spark, "t")),
        "templates": lambda d: drop_recurring(d, Scratch(spark, "t")),
        "language": lambda d: identify(d, {"a": b"some words of a", "b": b"other words of b"}),
        "simhash": lambda d: group(d, Scratch(spark, "t")),
        "words": lambda d: dedup_words(d, Scratch(spark, "t")),
        "bytes": lambda d: dedup_bytes(d, Scratch(spark, "t")),
        "tokens": lambda d: count_tokens(d, vocabulary_path()),
    }


def test_equal_ids_and_null_ids_keep_their_own_texts(spark, documents):
    rng = random.Random(4)
    texts = [(i, prose(rng, 30) + "\n" + prose(rng, 5 + n)) for n, i in enumerate([7, 7, None, None, 9])]
    docs = documents(*texts, texts[0], texts[2], (7, None), (None, None), (7, ""))
    apart = documents(*((100 + n, t) for n, (_, t) in enumerate(texts)))
    for name, run in runs(spark).items():
        found, alone = run(docs), run(apart)
        assert found.count() == 10, name
        told = [c for c in ("text", "n_words", "kept", "n_tokens", "n_bytes", "bits", "n_lines", "lang_pred", "n_removed") if c in found.columns and not (name == "mix" and c == "kept")]
        rows = [str(r) for r in found.select(told).collect()]
        # A text of its own is told like one whose id is its own; the repeated rows are told alike.
        wanted = [str(r) for r in alone.select(told).collect()]
        assert all(w in rows for w in wanted), name


def test_extra_columns_do_no_harm(spark, awkward):
    docs = awkward.withColumns({c: F.lit("own") for c in EXTRA})
    n, plain = docs.count(), awkward
    for run in runs(spark).values():
        found, wanted = run(docs), run(plain)
        shared = [c for c in wanted.columns if c not in EXTRA or c not in found.columns or c in ("kept", "n_words", "component_id", "score")]
        assert found.count() == n
        assert sorted(map(str, found.select(shared).collect())) == sorted(map(str, wanted.select(shared).collect()))
