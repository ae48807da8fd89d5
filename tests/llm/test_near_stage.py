import random

import corpus_pipeline
import pytest
from llm_samples import SCHEMA, prose  # noqa: F401
from test_similar_texts import brute

from millrace.llm import set_join, simhash
from millrace.llm.common import Scratch


def differing(a, b):
    return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()


def test_groups_come_through_simhash_are_checked_and_completed(spark, documents, monkeypatch, tmp_path):
    rng = random.Random(2)
    base = [prose(rng, 300) for _ in range(12)]
    near = [f"{t} {prose(rng, 1)}" for t in base]
    far = [" ".join(w if i % 60 else "changed" for i, w in enumerate(t.split())) for t in base]
    close = {i for i in range(12) if differing(base[i], near[i]) <= 4}
    beyond = {i for i in range(12) if differing(base[i], far[i]) > 4 and differing(near[i], far[i]) > 4}
    assert len(close) > 8 and beyond
    # One repeated word makes equal fingerprints of texts that share little.
    unlike = ["word " * 60 + prose(rng, 6), "word " * 60 + prose(rng, 6)]
    assert differing(*unlike) <= 4
    docs = documents(*base, *near, *far, *unlike)

    def kept():
        return {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()}

    assert kept() == {*range(12), 36, 37}
    # Without keys the join of sets finds nothing: what goes is what SimHash links.
    monkeypatch.setattr(set_join, "_keys", lambda *_: spark.createDataFrame([], "key long, node long, size int, most int"))
    alone = kept()
    assert {i for i in range(12) if 12 + i not in alone} >= close and {36, 37} <= alone
    assert all(24 + i in alone for i in beyond)


@pytest.mark.parametrize("crowd", [0, 150])
def test_components_stay_those_of_all_pairs(spark, documents, crowd):
    rng = random.Random(17)
    form = prose(rng, 60).split()
    texts = [" ".join(w if i not in cut else prose(rng, 1) + "x" for i, w in enumerate(form)) for cut in (rng.sample(range(60), rng.randint(0, 3)) for _ in range(crowd))]
    for n in [3, 5, 8, 12, 30, 100] * 3:
        words = prose(rng, n).split()
        texts += [" ".join(words), " ".join([*words, "added"]), " ".join([words[0], "inside", *words[1:]]), " ".join(words).upper()]
    docs = documents(*texts, None, "")
    found = set_join.similar(docs, Scratch(spark, "t"), prints=simhash.fingerprints(docs)).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(brute([*texts, None, ""])))
