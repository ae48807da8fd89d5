import hashlib
import random
import re
import string

import pytest
import xxhash
from llm_samples import SCHEMA, prose  # noqa: F401

from millrace.llm import spotsigs as s
from millrace.llm.common import Scratch


def slow(text):
    """The signatures of a text, told word by word."""
    words = "".join(" " if c in string.punctuation or ord(c) < 32 else c for c in (text or "").lower()).split(" ")
    words = [w for w in words if w]
    common = {a.decode() for a in s.ANCHORS}
    content = [(i, w) for i, w in enumerate(words) if w not in common]
    chains = set()
    for i, w in enumerate(words):
        after = [c for at, c in content if at > i][:3]
        if w in common and len(after) == 3:
            chains.add(" ".join([w, *after]))
    if len({xxhash.xxh32_intdigest(c) for c in chains}) < 4:
        chains |= {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}
    return {xxhash.xxh32_intdigest(c) for c in chains or {" ".join(words)}}


def hexed(found):
    return "".join(f"{x:08x}" for x in sorted(found))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_edits_in_order(spark, documents, monkeypatch, empty):
    monkeypatch.setattr(s, "BETWEEN", 3)
    rng = random.Random(2)
    texts = {i: re.sub("er", lambda m: rng.choice(("er", " the ", ", und ")), prose(rng, rng.randint(0, 60))) for i in rng.sample(range(100), 17)}
    texts[200], texts[300] = None, texts[min(texts)]
    found = {r.doc_id: r for r in s.compare_edits(documents(*texts.items()), Scratch(spark, "t")).collect()}
    ids = sorted(texts)
    sets = {i: slow(texts[i]) for i in ids}
    for n, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(sets[i]), hexed(slow(changed)))
        assert r.near_edited == pytest.approx(jaccard(sets[i], slow(changed))) and r.near_next == pytest.approx(jaccard(sets[i], slow(after)))
        assert r.class_id == min(k for k in ids if jaccard(sets[i], sets[k]) >= 0.8)
    assert s.compare_edits(empty, Scratch(spark, "t")).count() == 0
    alone = s.compare_edits(documents("the one and only text"), Scratch(spark, "t")).first()
    assert alone.near_next == 1.0


def test_awkward_clashing_and_equal_ids(spark, documents, awkward):
    wanted = s.compare_edits(awkward, Scratch(spark, "t")).collect()
    assert len(wanted) == awkward.count() and all(0 <= r.near_edited <= 1 and r.fingerprint for r in wanted)
    clash = awkward.selectExpr("*", "1 as part", "2 as tail", "'x' as told", "3 as class_id", "4 as h", "'y' as fingerprint", "5 as ord")
    assert sorted(map(str, s.compare_edits(clash, Scratch(spark, "t")).collect())) == sorted(map(str, wanted))
    rng = random.Random(1)
    a, b, c = (prose(rng, 50) for _ in range(3))
    found = s.compare_edits(documents((None, a), (None, b), (7, c), (7, a), (7, a), (9, b + " " + b)), Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.class_id)) for r in found) == sorted([("None", hexed(slow(a)), "7"), ("None", hexed(slow(b)), str([r.class_id for r in found if r.doc_id is None and r.fingerprint == hexed(slow(b))][0])), ("7", hexed(slow(c)), "7"), ("7", hexed(slow(a)), "7"), ("7", hexed(slow(a)), "7"), ("9", hexed(slow(b + " " + b)), "9")])


def test_near_duplicates_against_all_pairs(spark, documents):
    rng = random.Random(4)
    texts = []
    for _ in range(10):
        base = prose(rng, 300).split()
        base = [w if rng.random() < 0.7 else "the" for w in base]
        texts.append(" ".join(base))
        for k in (1, 4, 30):
            texts.append(" ".join(w if rng.random() > k / 300 else "new" for w in base))
    texts += texts[:3]
    sets = [s.signatures(t) for t in texts]
    parent = list(range(len(texts)))

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i in range(len(texts)):
        for j in range(i):
            if s.likeness(sets[i], sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    found = {r.doc_id: r.class_id for r in s.near_duplicates(documents(*texts), Scratch(spark, "t")).collect()}
    assert found == {i: top(i) for i in range(len(texts))}
