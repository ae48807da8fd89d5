import random

import numpy as np
import pytest
from llm_samples import SCHEMA, prose  # noqa: F401

from millrace.llm import set_join
from millrace.llm.common import Scratch


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(texts, similarity=0.8):
    """The least number of each text's component, over all pairs."""
    sets, least = [shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= similarity * len(a | b) - 1e-9]
    for _ in texts:
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
    return least


def found(spark, docs):
    return {r.doc_id: r.component_id for r in set_join.similar(docs, Scratch(spark, "t")).collect()}


def test_texts_below_the_similarity_stay_apart(spark, documents):
    rng = random.Random(5)
    base = [prose(rng, 200) for _ in range(10)]
    texts = [*base, *(" ".join(t.split()[:155]) + " " + prose(rng, 45) for t in base)]  # Jaccard about 0.63
    texts += ["word " * 60 + prose(rng, 12), "word " * 60 + prose(rng, 12)]  # one long repeated word
    assert found(spark, documents(*texts)) == dict(enumerate(range(len(texts))))


@pytest.mark.parametrize("crowd", [0, 90, 250])
def test_components_equal_all_pairs_around_the_similarity(spark, documents, crowd):
    rng = random.Random(7)
    base = prose(rng, 60).split()
    texts = [" ".join(w if i not in cut else prose(rng, 1) + "x" for i, w in enumerate(base)) for cut in (rng.sample(range(60), rng.randint(0, 3)) for _ in range(crowd))]
    for n in [3, 4, 5, 6, 8, 8, 8, 9, 12, 20, 30, 40, 60, 100] * 2:
        words = prose(rng, n).split()
        for more in range(3):
            at = rng.randrange(n + 1)
            texts += [" ".join(words), " ".join([*words, *["added"] * more]), " ".join([*words[:at], "inside", *words[at:]])]
    assert found(spark, documents(*texts)) == dict(enumerate(brute(texts)))


def test_sets_come_back_and_zero_is_one_of_them():
    found = np.concatenate((np.zeros(1, np.uint64), np.sort(np.random.default_rng(1).integers(0, 2**64, 999, np.uint64))))
    assert (set_join.unpacked(set_join.packed(found).tobytes()) == found >> np.uint64(24)).all()


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_first_shared_members_reach_every_similar_partner(similarity):
    """Over all sizes and overlaps: the first shared member stands early enough in both sets, and its place admits the other's size."""
    for n in range(1, 40):
        for m in range(1, 40):
            for both in range(1, min(n, m) + 1):
                if both >= similarity * (n + m - both) - 1e-9:
                    # At worst all members that are not shared come first.
                    i, j = n - both, m - both
                    assert i < set_join.leading(n, similarity) and j < set_join.leading(m, similarity)
                    assert set_join.reach(n, np.array([i]), similarity)[0] >= m and set_join.reach(m, np.array([j]), similarity)[0] >= n


def test_letters_of_one_form_do_not_meet(spark, documents):
    rng = random.Random(3)
    form = prose(rng, 120).split()

    def letter(i):
        words = list(form)
        for place, kind in ((10, "name"), (50, "town"), (90, "day")):
            words[place] = f"{kind}{i}"
        return " ".join(words)

    letters = [letter(i) for i in range(300)]
    near = letters[7].split()
    near[119] = "other"
    docs = documents(*letters, " ".join(near))
    scratch = Scratch(spark, "t")
    sets = set_join.Shingles()
    keys = set_join._keys(docs, set_join._common(docs, sets, 0.8), sets, 0.8)
    left = set_join.map_arrow(keys.repartition("key").sortWithinPartitions("key", "node"), set_join._shared, "key long, node long, size int, most int, n long")
    assert left.where("n > 2").count() == 0 and left.select("node").distinct().count() == 2
    assert {i: c for i, c in found(spark, docs).items() if c != i} == {300: 7}
