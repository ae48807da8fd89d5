import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_samples import SCHEMA, prose  # noqa: F401

from millrace.llm import templates
from millrace.llm.common import Scratch
from millrace.llm.templates import Leaf, beside, drop_recurring, line_sketches


def test_leaves_generalise_fields():
    leaf = Leaf(0.7)
    assert [leaf.take(x) for x in ("user a logged in today", "user b logged in today", "quite other words stand here")] == [0, 0, 1]
    assert leaf.shown(0) == "user <*> logged in today"


def kept(spark, docs):
    return {r.doc_id: r.text for r in drop_recurring(docs, Scratch(spark, "t")).collect()}


def test_recurring_lines_go_and_copies_stay(spark, documents):
    rng = random.Random(5)
    texts = [f"{prose(rng, 30)}\nPosted by reader {i} on this page\n{prose(rng, 30)}" for i in range(8)]
    copy = prose(rng, 40) + "\n" + prose(rng, 12)
    docs = documents(*texts, *[copy] * 9, None, "", "Of.\nOf.")
    found = {r.doc_id: r for r in drop_recurring(docs, Scratch(spark, "t")).collect()}
    assert all(found[i].text == "\n".join(texts[i].split("\n")[::2]) and found[i].n_dropped == 1 for i in range(8))
    assert all(found[i].text == copy for i in range(8, 17))
    assert found[17].text is None and found[18].text == "" and found[19].text == "Of.\nOf."


def test_short_lines_copies_beside_others_and_long_lines(spark, documents):
    rng = random.Random(6)
    passage, licence = prose(rng, 60), "this work is free for all to use"
    others = [f"{prose(rng, 70)}\nAll rights.\n{passage}\n{licence}\n12" for _ in range(40)]
    # Copies of one more document hold the licence too: many exact ones, and near ones with a word exchanged.
    copied = f"{prose(rng, 80)}\n{licence}\n{prose(rng, 80)}\n{prose(rng, 80)}"
    near = []
    for i in range(60):
        words = copied.split(" ")
        words[rng.choice([n for n, w in enumerate(words) if "\n" not in w and n < 70])] = f"new{'abcdefghij'[i % 10]}"
        near.append(" ".join(words))
    found = kept(spark, documents(*others, *[copied] * 150, *near))
    assert all(found[i] == t.split("\n")[0] for i, t in enumerate(others))
    assert all(found[40 + i] == t.replace("\n" + licence, "") for i, t in enumerate([*[copied] * 150, *near]))


def test_crowded_leaves_are_split(spark, documents, monkeypatch):
    monkeypatch.setattr(templates, "CROWD", 25)
    rng = random.Random(8)
    texts = [f"{prose(rng, 30)}\n1 2 3 {'left' if i % 2 else 'right'} {prose(rng, 1)}x y z" for i in range(40)]
    found = kept(spark, documents(*texts))
    assert all(found[i] == t.split("\n")[0] for i, t in enumerate(texts))


@pytest.mark.parametrize("place", [0, 1, 2, 3, 4, 5, 8, 9])
def test_crowded_leaves_drop_what_others_do(spark, documents, monkeypatch, place):
    """The same lines go on both sides of the switch, wherever the field stands (before the leading tokens' end, each line has a leaf of its own)."""
    rng = random.Random(place)
    form = "Photo taken by X on the square of our town".split()

    def line(i):
        words = list(form)
        words[place] = f"name{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abc'[i // 26]}"
        return " ".join(words)

    other = [f"Photo taken by {prose(rng, 7)}" for _ in range(60)]
    texts = [f"{prose(rng, 30)}\n{line(i)}\n{other[i]}" for i in range(60)]
    plain = kept(spark, documents(*texts))
    monkeypatch.setattr(templates, "CROWD", 50)
    assert kept(spark, documents(*texts)) == plain
    if place >= 3:
        assert all(plain[i] == "\n".join((t.split("\n")[0], t.split("\n")[2])) for i, t in enumerate(texts))


def test_repeated_lines_and_several_fields_in_crowded_leaves(spark, documents, monkeypatch):
    rng = random.Random(1)
    every = "All of this page was set in type and printed here"
    texts = [f"{prose(rng, 30)}\nAll of this {prose(rng, 8)}\nAll of this book was bought by {prose(rng, 1)}q for {prose(rng, 1)}z coins\n{every}" for _ in range(40)]
    plain = kept(spark, documents(*texts))
    monkeypatch.setattr(templates, "CROWD", 20)
    assert kept(spark, documents(*texts)) == plain
    assert all(plain[i] == "\n".join(t.split("\n")[:2]) for i, t in enumerate(texts))


def test_sketches_leave_out_the_line():
    rng = random.Random(2)
    lines = [prose(rng, n).split() for n in (1, 2, 9, 4, 30)]
    lines.append(lines[2])
    sketch, names = line_sketches(lines), np.array([1, 2, 3, 4, 5, 3], np.uint64)
    for i, name in enumerate(names):
        others = [n for n in range(6) if names[n] != name]
        assert beside(sketch, names)[i].tolist() == sketch[others].min(axis=0).tolist()
    assert (sketch[2] == sketch[5]).all() and line_sketches([lines[0]])[0].tolist() == sketch[0].tolist()
    assert beside(sketch[:1], names[:1]).tolist() == [[0] * templates.SKETCH]


def naive(texts):
    """Numbers of dropped lines of each of some unrelated texts, by a plain tree."""
    lines = [[(n, line.split()) for n, line in enumerate(t.split("\n")) if line.strip()] for t in texts]
    shown = lambda t: [("<*>" if re.search(r"\d", w) else w) for w in t] if len(t) > 3 else t
    order = {" ".join(shown(t)) for doc in lines for _, t in doc}
    order = sorted(order, key=lambda m: np.uint64(xxhash.xxh64_intdigest(m.encode())).view(np.int64))
    busy = defaultdict(int)
    key = lambda t: (len(t), *shown(t)[:3]) if len(t) > 3 else ("short", *t)
    for doc in lines:
        for _, t in doc:
            busy[key(t)] += 1
    tree, of = defaultdict(list), {}
    for masked in order:
        tokens = masked.split(" ")
        leaf = tree[key(tokens)]
        scores = [sum(a == b for a, b in zip(x, tokens, strict=True)) for x in leaf]
        if scores and max(scores) >= 0.7 * len(tokens):
            at = scores.index(max(scores))
            leaf[at] = [a if a == b else "<*>" for a, b in zip(leaf[at], tokens, strict=True)]
        else:
            at = len(leaf)
            leaf.append(tokens)
        of[masked] = (key(tokens), at)
    docs = defaultdict(set)
    for d, doc in enumerate(lines):
        for _, t in doc:
            if busy[key(t)] >= 5:
                docs[of[" ".join(shown(t))]].add(d)
    return [{n for n, t in doc if len(docs[of[" ".join(shown(t))]]) >= 5} for doc in lines]


def test_against_a_plain_tree(spark, documents):
    rng = random.Random(9)
    forms = ["login of {} from host {} ok", "login of {} from port {} ok", "page {} of {} seen by {} now", "Done.", "End of {}", "see also the {} list of {}"]
    texts = []
    for i in range(60):
        rows = [prose(rng, 40)]
        for _ in range(rng.randint(0, 4)):
            rows.append(rng.choice(forms).format(*(rng.choice(("a", "bb", "c9", str(rng.randint(0, 99)))) for _ in range(3))))
        rng.shuffle(rows)
        texts.append("\n".join(rows))
    found, wanted = kept(spark, documents(*texts)), naive(texts)
    assert sum(map(len, wanted)) > 60
    for i, t in enumerate(texts):
        assert found[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in wanted[i])


@pytest.mark.parametrize("n", [4, 5, 6, 10, 17])
def test_templates_looked_up_are_those_of_all(n):
    rng = random.Random(n)
    words = [w + "abc"[i % 3] for i, w in enumerate(prose(rng, 12).split())] + ["<*>"] * 3
    lines = list({" ".join(["one", "<*>", "three", *(rng.choice(words[: rng.choice((3, 15))] + ["<*>"]) for _ in range(n - 3))]) for _ in range(1500)})
    for alike in (0.7, 0.9):
        plain, quick = Leaf(alike, crowd=10**9), Leaf(alike, crowd=5)
        assert [plain.take(x) for x in lines] == [quick.take(x) for x in lines]
        assert all(plain.shown(i) == quick.shown(i) for i in range(plain.used)) and plain.used == quick.used


@pytest.mark.parametrize("crowd", [20, 10_000])
def test_large_leaves_equal_a_plain_tree(spark, documents, monkeypatch, crowd):
    """One leaf of lines that rare, common and variable tokens tell apart."""
    monkeypatch.setattr(templates, "CROWD", crowd)
    rng = random.Random(4)
    texts = []
    for i in range(150):
        ends = [rng.choice((f"q{'abcdefghij'[i % 10]}{'abcdefghijklmno'[i // 10]}", "red", "blue", "green", "7")) for _ in range(14)]
        texts.append("\n".join([prose(rng, 40), *(" ".join(["One", "of", "these", *ends[k : k + 7]]) for k in (0, 7))]))
    found, wanted = kept(spark, documents(*texts)), naive(texts)
    assert 0 < sum(map(len, wanted)) < 300
    for i, t in enumerate(texts):
        assert found[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in wanted[i])


def test_awkward_and_empty(spark, awkward, empty):
    assert drop_recurring(awkward, Scratch(spark, "t")).count() == awkward.count()
    assert drop_recurring(empty, Scratch(spark, "t")).count() == 0
