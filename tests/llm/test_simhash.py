import random
import re

import numpy as np
import xxhash
from llm_samples import SCHEMA, prose  # noqa: F401

from millrace.llm import simhash, set_join
from millrace.llm.common import Scratch
from millrace.llm.components import components


def slow(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_fingerprints(awkward):
    for r in awkward.collect():
        assert simhash.fingerprint(r.text) == slow(r.text)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    wanted = roots({n for x in links for n in x}, links)
    assert found == {n: r for n, r in wanted.items() if n != r}


def test_links_with_and_without_crowds(spark, monkeypatch):
    rng = random.Random(3)
    prints = []
    for _ in range(25):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(4)]
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "bits long")
    signed = sorted({int(np.uint64(p).view(np.int64)) for p in prints})
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    wanted = {n: r for n, r in roots(signed, links).items() if n != r}
    for crowd in (4096, 1):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        run = simhash._meetings.__globals__
        monkeypatch.setitem(run, "CROWD", crowd)
        assert {r.bits: r.root for r in simhash.linked(frame, Scratch(spark, "t")).collect()} == wanted


def test_groups_of_awkward_rows(spark, awkward, empty):
    found = {r.doc_id: r.component_id for r in simhash.group(awkward, Scratch(spark, "t")).collect()}
    assert found[0] == found[1] == found[2] == 0 and found[3] == found[4] == found[5] == 3
    assert simhash.group(empty, Scratch(spark, "t")).count() == 0


def test_similar_texts_meet(spark, documents):
    rng = random.Random(8)
    base = [prose(rng, 400) for _ in range(12)]
    near = [" ".join(w if i % 97 else "changed" for i, w in enumerate(t.split())) for t in base]
    found = {r.doc_id: r.component_id for r in set_join.similar(documents(*base, *near, None, ""), Scratch(spark, "t")).collect()}
    assert all(found[i] == found[i + 12] == i for i in range(12)) and found[24] == found[25] == 24
