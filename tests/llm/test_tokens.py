import random

import pytest

from millrace.llm.tokens import Counter, count_tokens, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


def test_counts_equal_the_library():
    library, own, rng = tokenizers.Tokenizer.from_file(vocabulary_path()), Counter(vocabulary_path()), random.Random(2)
    pieces = [*"aab ' \n\t’éß漢1²½_-🙂\x1c\x85　", "<|endoftext|>", "<|endo", "  ", "\n\n", "'ll", "aaaaaaa", " the", "ing"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(1500)] + ["", "a" * 3000, " " * 999, "ab" * 2000, "\n" * 50]
    assert own.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_rows(spark, awkward, empty):
    found = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(awkward, vocabulary_path()).collect())
    assert found[1] == (0, 0, 0, False) and found[2] == (1, 0, 0, False) and len(found) == awkward.count()
    assert all(over == (n > 512) for _, _, n, over in found)
    assert count_tokens(empty, vocabulary_path()).count() == 0
