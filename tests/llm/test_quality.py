import random

import numpy as np
from llm_samples import prose

from millrace.llm import quality
from millrace.llm.quality import FEATURES, Attention, bags, fit, learn, score

LABELS = "doc_id long, quality int"


def bad(rng, words):
    """Three kinds of poor text."""
    out = words.split()
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in out)
    return " | ".join(out) if kind == 1 else " ".join(w for w in out[: len(out) // 9 + 1] for _ in range(9))


def made(rng, n):
    """(id, text, label): a poor passage anywhere makes a document poor."""
    rows = []
    for i in range(n):
        good = i % 3 > 0
        parts = [prose(rng, rng.choice((60, 90))) for _ in range(rng.choice((1, 3, 9)))]
        if not good:
            at = rng.randrange(len(parts))
            parts[at] = bad(rng, parts[at])
        rows.append((i, " ".join(parts), int(good)))
    return rows


def test_held_out_documents(spark):
    rng = random.Random(3)
    rows = made(rng, 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4] + [(None, 1), (5, None), (1, 0), (1, 1), (77777, 0)], LABELS)
    found = {r.doc_id: r.score for r in score(docs, learn(docs, labels)).collect()}
    right = [(found[i] >= 0.5) == bool(q) for i, _, q in rows if i % 4 == 0]
    assert sum(right) / len(right) > 0.9
    assert all(0 <= s <= 1 for s in found.values())


def plain(model, x):
    """Gated attention by its formula, for one bag."""
    p = model.p
    h = np.tanh((x - model.mean) / model.scale @ p["w"] + p["b"])
    logits = ((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["a"])[:, 0]
    w = np.exp(logits - logits.max())
    return float(1 / (1 + np.exp(-(((w / w.sum()) @ h) @ p["c"][:, 0] + p["d"][0]))))


def test_scores_against_the_formula(spark, awkward, monkeypatch):
    monkeypatch.setattr(quality, "AT_ONCE", 5)
    rng = random.Random(8)
    texts = [t for _, t, _ in made(rng, 30)]
    model = Attention.fresh(np.concatenate([np.concatenate(list(bags(t.encode()))) for t in texts]))
    model.p["d"] += 0.3
    got = score(awkward, model).collect()
    wanted = [plain(model, np.concatenate(list(bags((r.text or "").encode())))) for r in awkward.collect()]
    assert np.allclose(sorted(r.score for r in got), sorted(wanted))
    of = {r.doc_id: r.score for r in got}
    assert of[0] == of[1] == of[2] and of[3] == of[4] == of[5] and None in of


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    x, starts, labels = rng.normal(size=(9, FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    model = Attention.fresh(x)

    def loss():
        each = [plain(model, b) for b in np.split(x, starts[1:])]
        return -np.mean([np.log(s if y else 1 - s) for s, y in zip(each, labels, strict=True)])

    for name, g in model.gradients(x, starts, labels).items():
        for at in rng.integers(0, g.size, 4):
            was = model.p[name].flat[at]
            model.p[name].flat[at] = was + 1e-5
            up = loss()
            model.p[name].flat[at] = was - 1e-5
            down = loss()
            model.p[name].flat[at] = was
            assert abs((up - down) / 2e-5 - g.flat[at]) < 1e-6, name


def test_whole_texts_are_read(monkeypatch):
    rng = random.Random(2)
    text = prose(rng, 5000)
    whole = np.concatenate(list(bags(text.encode())))
    assert len(whole) == -(-5000 // quality.PASSAGE)
    monkeypatch.setattr(quality, "PIECE", 300)
    cut = list(bags(text.encode()))
    words = sum((c[:, 256] * quality.PASSAGE).sum() for c in cut)
    assert abs(words - 5000) < 1e-3 and len(cut) > 50
    assert [len(np.concatenate(list(bags(b"w " * n)))) for n in (1, 2, 3, 5, 64, 65)] == [1, 1, 1, 1, 1, 2]
    assert len(list(bags(b"x" * 1000))) == 4 and len(list(bags(b"  \n"))) == 1


def test_labels_of_one_kind_or_none(spark, documents, empty):
    docs = documents("a b c", None)
    assert [r.score for r in score(docs, learn(docs, spark.createDataFrame([], LABELS))).collect()] == [0.5, 0.5]
    assert [r.score for r in score(docs, learn(docs, spark.createDataFrame([(0, 1)], LABELS))).collect()] == [1.0, 1.0]
    assert score(empty, learn(empty, spark.createDataFrame([(0, 1), (1, 0)], LABELS))).count() == 0


def test_repeated_ids_stay_within_the_sample(spark):
    docs = spark.createDataFrame([(1, f"good words {i}") for i in range(30)] + [(2, "BAD!!")], "doc_id long, text string")
    found, answers = quality.training_bags(docs, spark.createDataFrame([(1, 1), (2, 0)], LABELS), sample=5)
    assert sorted(answers.tolist()) == [0.0] + [1.0] * 5 and len(found) == 6


def test_learning_is_repeatable():
    rng = np.random.default_rng(1)
    found = [rng.normal(size=(k % 3 + 1, FEATURES)) + k % 2 for k in range(20)]
    labels = np.array([k % 2 for k in range(20)], float)
    a, b = fit(found, labels, 2), fit(found, labels, 2)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
