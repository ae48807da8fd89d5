import random

import pytest

from llm_samples import SCHEMA, prose  # noqa: F401

from millrace.llm import decontaminate
from millrace.llm.decontaminate import contaminated, indexes, normal


def distance(item, text):
    before = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[-1] + 1))
        before = now
    return min(before)


def found_in(items, text):
    return {index.ids[i]: e for index in indexes(list(enumerate(items)), 12, 0.07) for _, i, e, _, _ in index.matches([text])}


@pytest.mark.parametrize("piece", [4 << 20, 3])
def test_edits_against_full_alignment(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    rng = random.Random(6)
    items = [normal(prose(rng, n)) for n in (20, 20, 20, 8, 6, 5, 4, 12)]
    items += [x[:n] for x, n in zip(items * 2, (15, 16, 28, 29, 30, 42, 43, 44, 58), strict=False)]
    for turn in range(150):
        n = turn % len(items)
        part, budget = bytearray(items[n]), int(len(items[n]) * 0.07)
        for _ in range(rng.randint(0, budget + 2)):
            at = rng.randrange(len(part))
            part[at : at + rng.randint(0, 1)] = rng.choice((b"", b"z", b"zz"))
        text = normal(prose(rng, 15)) + b" " + bytes(part) + b" " + normal(prose(rng, 15))
        best = distance(items[n], text)
        assert found_in(items, text).get(n) == (best if best <= budget else None)


def test_short_items_stand_as_whole_words():
    items = [b"yes", b"forty two", b"a b", b""]
    assert found_in(items, b"well yes, forty two of a b") == {0: 0, 1: 0, 2: 0}
    assert found_in(items, b"eyes forty twos xa b") == {}
    assert found_in(items, b"eyes yes") == {0: 0}


def test_common_grams_are_met_in_pieces(monkeypatch):
    rng = random.Random(2)
    items = [normal("the answer to the question of everything " + prose(rng, 12)) for _ in range(50)]
    text = b" ".join([normal("the answer to the question of everything")] * 40 + items[:3])
    whole = found_in(items, text)
    monkeypatch.setattr(decontaminate, "PIECE", 100)
    assert found_in(items, text) == whole and {0, 1, 2} <= set(whole)


def test_rows(spark, documents, awkward, empty):
    rng = random.Random(9)
    item = prose(rng, 25)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short"), (4, item)], "item_id long, text string")
    docs = documents("before " + item.upper() + " after", prose(rng, 90), item.replace(" ", "\n  "), None, "")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in contaminated(docs, bench).collect()) == [(0, 1, 0), (0, 4, 0), (2, 1, 0), (2, 4, 0)]
    assert contaminated(awkward, bench).count() == 0 and contaminated(empty, bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
    odd = documents((None, "x " + item), (5, item), (5, "quite other"), (5, item), (6, item * 400)).selectExpr("*", "1 as item_id", "'own' as passage", "2 as edits")
    odd_bench = spark.createDataFrame([(None, item, 1), (7, "", 2)], "item_id long, text string, doc_id int")
    assert sorted((str(r.doc_id), str(r.item_id), r.edits) for r in contaminated(odd, odd_bench).collect()) == [("5", "None", 0), ("5", "None", 0), ("6", "None", 0), ("None", "None", 0)]
