import math
import random
import re
from collections import Counter

import pytest
from llm_samples import prose

from millrace.llm import ranking
from millrace.llm.ranking import factors, rank, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    """The contract, item by item and document by document."""
    counted = [(i, k, Counter(cut(t))) for k, (i, t) in enumerate(docs)]
    counted = [c for c in counted if c[2]]
    n, total = len(counted), sum(sum(c.values()) for *_, c in counted)
    df = Counter(t for *_, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc_id, k, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, k))
        out += [(item, r, d if there else None, -s) for r, (s, there, d, _) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    a = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, rank string")
    b = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in rank(a, b, **more).collect()), key=repr)


def corpus(rng, n):
    """Texts that share frequent words, some rare ones, and groups of copies."""
    docs = []
    for i in range(n):
        words = prose(rng, rng.choice((5, 40, 200))).split() + [f"rare{rng.randrange(n)}"] * rng.randrange(3) + ["the"] * rng.randrange(9)
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    return docs + [(n + i, docs[3][1]) for i in range(80)]


@pytest.mark.parametrize(("top", "shard", "bundle"), [(50, 8192, 256), (3, 40, 4), (60, 7, 2)])
def test_against_brute_force(spark, monkeypatch, top, shard, bundle):
    monkeypatch.setattr(ranking, "BUNDLE", bundle)
    rng = random.Random(top)
    docs = corpus(rng, 300)
    items = [(i, " ".join(rng.sample(docs[rng.randrange(300)][1].split(), 4)) + " The rare7 nowhere" * (i % 2)) for i in range(9)]
    items += [(100, None), (101, ""), (102, "--- !!"), (103, "nowhere at all"), (104, "the"), (105, docs[3][1])]
    assert found(spark, docs, items, top=top, shard=shard) == brute(docs, items, top)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "Straße ÉTÉ été x1"), (4, "Straße ÉTÉ été x1"), (None, "x1 y"), (None, "x1 y"), (5, "a\x00b\x7fc " * 30), (6, "B C " * 4000)]
    items = [(1, "ÉTÉ STRASSE"), (1, "Straße"), (None, "X1"), (2, "a c"), (3, "b,b,b")]
    assert found(spark, docs, items) == brute(docs, items)


def test_blocks_of_queries_change_nothing(spark):
    rng = random.Random(9)
    docs = corpus(rng, 60)
    items = [(i, " ".join(rng.sample(docs[i][1].split(), 3))) for i in range(6)]
    assert found(spark, docs, items, block_bytes=40) == brute(docs, items)


def test_nothing_to_rank(spark):
    assert found(spark, [], [(1, "a")]) == found(spark, [(1, "a")], []) == found(spark, [(1, "b")], [(1, "a")]) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(ranking, "PIECE", 7)
    raw = "Alpha beta,GAMMA delta_epsilon 漢字漢字漢字 z".encode()
    assert [t.decode() for piece in terms(raw) for t in piece] == cut(raw.decode())


def test_factors_stay_below_the_bound():
    import numpy as np

    assert factors(np.array([1, 2**30]), np.array([50, 50])).tolist() == [500000, 999999]
