"""Substring and suffix-array dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from millrace.llm import repeats
from millrace.llm.common import Scratch
from millrace.llm.fm_index import FmIndex
from millrace.llm.run_index import RunIndex
from millrace.llm.substrings import Words, dedup_words
from millrace.llm.suffix_array import Bytes, dedup_bytes
from millrace.llm.suffixes import suffix_order


def brute(rows, window):
    """Which symbols go: rows of (id, text key, symbols), equal rows being one document."""
    seen, gone = set(), {}
    for key in sorted({(float("-inf") if i is None else i, t or "") for i, t, _ in rows}):
        symbols = next(s for i, t, s in rows if ((float("-inf") if i is None else i), t or "") == key)
        mask = bytearray(len(symbols))
        for p in range(len(symbols) - window + 1):
            w = tuple(symbols[p : p + window])
            if w in seen:
                mask[p : p + window] = b"\x01" * window
            seen.add(w)
        gone[key] = mask
    return gone


def rows_of(frame, cut):
    return [(r.doc_id, r.text, cut(r.text or "")) for r in frame.collect()]


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_words_against_brute_force(spark, awkward, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    cut = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    gone = brute(rows_of(awkward, cut), 20)
    wanted = sorted((i if i > float("-inf") else -1, len(m), sum(m), " ".join(w for w, g in zip(cut(t), m, strict=True) if not g)) for (i, t), m in gone.items())
    found = {(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup_words(awkward, Scratch(spark, "t")).collect()}
    assert sorted(found) == wanted


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_bytes_against_brute_force(spark, awkward, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    gone = brute(rows_of(awkward, lambda t: list(t.encode())), 100)
    wanted = sorted((i if i > float("-inf") else -1, len(m), sum(m), len(re.findall(b"\x01+", bytes(m))), hashlib.sha256(bytes(b for b, g in zip(t.encode(), m, strict=True) if not g)).hexdigest()) for (i, t), m in gone.items())
    found = {(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in dedup_bytes(awkward, Scratch(spark, "t")).collect()}
    assert sorted(found) == wanted


def test_empty_tables(spark, empty):
    assert dedup_words(empty, Scratch(spark, "t")).count() == 0
    assert dedup_bytes(empty, Scratch(spark, "t")).count() == 0


def corpus(rng, depth, kind):
    """Sequences, some equal or alike, with zeros after each: (text, begins, ends)."""
    parts = [rng.integers(1, 4, rng.integers(depth, 3 * depth)) for _ in range(5)]
    parts += [parts[0].copy(), parts[1][: depth + 1], np.full(2 * depth, 2)]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(kind)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    return text, ends - [len(p) for p in parts], ends


@pytest.mark.parametrize(("index", "kind", "depth"), [(FmIndex, np.int64, 3), (FmIndex, np.int64, 20), (RunIndex, np.uint8, 8), (RunIndex, np.uint8, 21)])
def test_indexes_find_the_earliest_place_of_each_window(index, kind, depth):
    rng = np.random.default_rng(depth)
    for _ in range(10):
        text, begins, ends = corpus(rng, depth, kind)
        made = index(text, depth)
        assert not hasattr(made, "order") and not hasattr(made, "bwt")
        found = {int(p): int(e) for _, at, group in made.stream(text, begins, ends) for p, e in zip(at, made.earliest(group), strict=True)}
        places = [p for b, e in zip(begins, ends, strict=True) for p in range(b, e - depth + 1)]
        same = {p: [q for q in places if (text[q : q + depth] == text[p : p + depth]).all()] for p in places}
        assert found == {p: min(q) for p, q in same.items() if len(q) > 1}


@pytest.mark.parametrize(("index", "kind"), [(FmIndex, np.int64), (RunIndex, np.uint8)])
def test_copies_count_as_if_they_stood_in_the_text(index, kind):
    rng, depth = np.random.default_rng(8), 6
    parts = [rng.integers(1, 4, n).astype(kind) for n in (30, 7, 6, 12, 3)]
    times = np.array([3, 1, 4, 2, 5])
    once = np.concatenate([np.append(p, 0) for p in parts]).astype(kind)
    every = np.concatenate([np.append(p, 0) for p, n in zip(parts, times, strict=True) for _ in range(n)]).astype(kind)
    made = index(once, depth, np.repeat(times, [len(p) + 1 for p in parts]))
    assert made.n == len(every)
    whole = every.tobytes()
    windows = {whole[i * every.itemsize : (i + depth) * every.itemsize] for i in range(len(every) - depth) if every[i : i + depth].all()}
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins, found = ends - [len(p) for p in parts], {}
    for _, at, group in made.stream(once, begins, ends):
        for p, g in zip(at.tolist(), group.tolist(), strict=True):
            found[once[p : p + depth].tobytes()] = int(made.end[g] - made.start[g])
    counts = {w: sum((every[i : i + depth].tobytes() == w) for i in range(len(every))) for w in windows}
    assert found == {w: n for w, n in counts.items() if n > 1}


def test_runs_of_copies_take_no_more_room():
    page = np.append(np.random.default_rng(9).integers(1, 200, 400), 0).astype(np.uint8)
    sizes = {len(RunIndex(page, 100, np.full(len(page), n)).keys) for n in (2, 50, 4000)}
    assert len(sizes) == 1


@pytest.mark.parametrize("kind", [Words(5, 2), Bytes(16, 8)])
def test_copies_are_judged_by_the_index(kind):
    rng = np.random.default_rng(10)
    pages = [b" ".join(b"abcdefgh"[x : x + 2] for x in rng.integers(0, 7, 30)) for _ in range(4)]
    segments = [pages[n] for n in (0, 1, 0, 2, 2, 1, 0, 3)] + [pages[3][20:], pages[0][30:]]
    seen, wanted = set(), set()
    for number, segment in enumerate(segments):
        symbols = segment.split(b" ") if isinstance(kind, Words) else list(segment)
        for at in range(len(symbols) - kind.window + 1):
            window = tuple(symbols[at : at + kind.window])
            if window in seen:
                wanted.add((number, at))
            seen.add(window)
    which, offset = repeats.repeated_windows(kind, segments)
    found = list(zip(which.tolist(), offset.tolist(), strict=True))
    assert len(found) == len(set(found)) and set(found) == wanted


@pytest.mark.parametrize("index", [FmIndex, RunIndex])
def test_counts_equal_the_transform(index):
    rng = np.random.default_rng(3)
    text, _, _ = corpus(rng, 9, np.uint8 if index is RunIndex else np.int64)
    order, starts = suffix_order(text, 9)
    tails = [tuple(text[i : i + 9]) for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (tails[i] + (0,) * 9)[:9] + (i,))
    assert starts.tolist() == [i for i in range(len(text)) if i == 0 or tails[order[i]] + (0,) * 9 != tails[order[i - 1]] + (0,) * 9]
    made, bwt = index(text, 9), text[order - 1]
    for symbol in range(4):
        at = np.arange(len(text))
        before, here = made.count(np.full(len(text), symbol), at)
        assert before.tolist() == [int((bwt[:i] == symbol).sum()) for i in at] and here.tolist() == (bwt == symbol).tolist()


def test_repetitive_text_takes_few_bytes():
    rng = np.random.default_rng(5)
    page = rng.integers(1, 200, 400)
    text = np.concatenate([np.append(page, 0)] * 200)
    plain = len(text) * int(text.max()).bit_length() * 12 // 64  # a word and a count for each 64 bits
    assert FmIndex(text, 20).size() < 0.5 * plain
    assert len(RunIndex(text.astype(np.uint8), 100).keys) < len(text) / 50


def test_packed_extensions_come_back():
    rng = np.random.default_rng(6)
    k, runs, h = (np.sort(rng.integers(-(2**62), 2**62, 50)), rng.integers(0, 2**60, 50), rng.integers(0, 2**63, 50).astype(np.uint64))
    back = repeats._unpacked(repeats._packed(k, runs, h))
    assert [x.tolist() for x in back] == [k.tolist(), runs.tolist(), h.astype(np.uint32).tolist()]


def test_one_bucket_or_many_batches_change_nothing(spark, awkward, monkeypatch):
    wanted = sorted(map(str, dedup_bytes(awkward, Scratch(spark, "t")).collect()))
    monkeypatch.setattr(repeats, "TOGETHER", 100)
    monkeypatch.setattr(repeats, "AT_ONCE", 100)
    monkeypatch.setattr(repeats, "LEAST_BUCKETS", 1)
    assert sorted(map(str, dedup_bytes(awkward, Scratch(spark, "t")).collect())) == wanted
