"""Repeated windows over all documents: content-defined shards, each with an index of its segments.

A window is a number of consecutive symbols (words or bytes) of one document; it repeats if its symbols also start
earlier (smaller id, or same document and earlier start). Every window is sent by its least gram (its minimizer), so equal
windows meet in one shard, and a shard never needs another's text:

1. runs of windows with one minimizer are the candidates. Around each minimizer stand half of a window's other symbols at least, on its
   left or its right, inside the window: the hashes of these two extensions are dealt into buckets and counted there, and runs
   of an extension that stands in two places are marked. Within a bucket hashes are told by 32 bits, so that one run in some
   hundred is marked for nothing at most, which costs a segment, at any size of the corpus;
2. documents meet their marked runs, which are cut out as segments;
3. in each shard, blocks of segments, copies too, are indexed and the segments streamed through the index: a window of a wide group that is not
   its earliest is a repeat. Minimizers with very many segments have theirs dealt out as single windows first, of which each batch
   sends first copies only, so that no shard takes an unbounded group.

An extension that a batch holds many times goes to its bucket once, so no bucket takes an unbounded group. Ids are ordered as numbers, null first; rows with
equal id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.workers import map_arrow
from millrace.llm.common import Scratch, mark_words, row_keys, split_by_marks
from millrace.llm.suffixes import Matches

#: Bytes of text handled at once, and symbols of an indexed block: of its different segments, and with their copies.
AT_ONCE, BLOCK, WITH_COPIES = 1 << 20, 1 << 18, 1 << 21
#: Windows of one segment; longer runs are cut.
MOST_WINDOWS = 255
#: Segments of one minimizer beyond which they are dealt out as windows.
CROWD = 20_000
#: Bytes of text whose equal extensions meet before any shuffle, and of crowded segments whose copies do.
TOGETHER = 64 << 20
#: Bytes of text whose extensions share a bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 128 << 20, 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SPANS = pa.schema([("__id", pa.int64()), ("__h", pa.int64()), ("start", pa.int64()), ("size", pa.int64())])
_CUTS = pa.schema([("m", pa.int64()), ("segment", pa.binary()), *_SPANS])
_SENT = pa.schema([("bucket", pa.int32()), ("k", pa.int64()), ("runs", pa.list_(pa.int64())), ("packed", pa.binary())])
_MARKS = pa.schema([("k", pa.int64()), ("runs", pa.list_(pa.int64()))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols: window and gram in symbols, and the index for shards."""

    window: int
    gram: int
    index: type[Matches]

    def tidy(self, text: str | None) -> bytes:
        """The text as bytes of which segments are cut."""
        raise NotImplementedError

    def hashes(self, joined: bytes) -> np.ndarray:
        """A hash of the gram from each symbol, over texts with one zero byte after each."""
        raise NotImplementedError

    def bounds(self, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each symbol begins and ends in the bytes; a text's end is a symbol too."""
        raise NotImplementedError

    def coded(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of segments with a zero after each, and their sizes."""
        raise NotImplementedError


class Batch:
    """Minimizers of the windows of some texts."""

    def __init__(self, kind: Symbols, texts: list[bytes]) -> None:
        joined = b"\x00".join(texts) + b"\x00"
        self.joined, (self.begin, self.end) = joined, kind.bounds(joined)
        zeros = np.flatnonzero(np.frombuffer(joined, np.uint8)[self.begin] == 0) if len(self.begin) else np.empty(0, np.int64)
        self.stops = zeros  # the symbol that ends each text
        n, w = len(self.begin), kind.window
        if n < w:
            self.windows = np.empty(0, np.uint64)
            self.grams = np.empty(0, np.uint64)
            return
        self.grams = kind.hashes(joined) | np.uint64(1)
        least = sliding(self.grams, w - kind.gram + 1, np.minimum)
        stop = np.repeat(zeros, np.diff(np.concatenate(([-1], zeros))))
        whole = np.arange(len(least)) + w <= stop[: len(least)]
        self.windows = np.where(whole, least, np.uint64(0))

    def selected(self, kind: Symbols) -> np.ndarray:
        """Places of grams that are some window's least."""
        if not len(self.windows):
            return np.empty(0, np.int64)
        reach = kind.window - kind.gram
        edge = np.zeros(reach, np.uint64)
        most = sliding(np.concatenate((edge, self.windows, edge)), reach + 1, np.maximum)
        return np.flatnonzero(most == self.grams)

    def extensions(self, kind: Symbols, places: np.ndarray) -> np.ndarray:
        """Hashes of the grams at ``places`` with their left and right extension: (2, places), 0 beyond a text."""
        reach = -(-(kind.window - kind.gram) // 2)
        text = np.searchsorted(self.stops, places)
        begin, end = np.concatenate(([0], self.stops[:-1] + 1))[text], self.stops[text]
        out = np.zeros((2, len(places)), np.uint64)
        for side, first in enumerate((places - reach, places)):
            inside = (first >= begin) & (first + reach + kind.gram <= end)
            at, h = first[inside], np.full(int(inside.sum()), side + 1, np.uint64)
            for step in (*range(0, reach, kind.gram), reach):
                h = mixed(h + self.grams[at + step])
            out[side, inside] = h
        return out

    def runs(self, kind: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows with one minimizer, and the extensions of its places in them.

        Gives (first window, windows, place of a minimizer in the first window) of runs, and (run, hash) of extensions.
        """
        m = self.windows
        none = np.empty(0, np.int64)
        if not len(m):
            return none, none, none, none, np.empty(0, np.uint64)
        places = self.selected(kind)
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        size = np.diff(np.append(first, len(m)))
        first, size = first[m[first] != 0], size[m[first] != 0]
        pieces = -(-size // MOST_WINDOWS)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces) + step * MOST_WINDOWS
        size = np.minimum(MOST_WINDOWS, np.repeat(first + size, pieces) - begin)
        # A run's own places among those of equal grams.
        values, rank = np.unique(self.grams[places], return_inverse=True)
        n = len(self.grams) + 1
        keys = rank * n + places
        order = np.argsort(keys)
        keys, places = keys[order], places[order]
        own = np.searchsorted(values, m[begin]) * n + begin
        low, high = np.searchsorted(keys, own), np.searchsorted(keys, own + size + kind.window - kind.gram)
        run = np.repeat(np.arange(len(begin)), high - low)
        at = np.arange(len(run)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        sides = self.extensions(kind, places)[:, at]
        run, sides = np.concatenate((run, run)), np.concatenate(tuple(sides))
        return begin, size, places[low], run[sides != 0], sides[sides != 0]


def _groups(batch: pa.RecordBatch, kind: Symbols) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Other columns and bytes of about ``AT_ONCE`` bytes of texts; ``text`` is the last column."""
    rows, texts, size = [], [], 0
    for *row, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(batch.num_columns - 1), strict=True):
        raw = kind.tidy(text.as_py())
        rows.append(row)
        texts.append(raw)
        size += len(raw)
        if size > AT_ONCE:
            yield rows, texts
            rows, texts, size = [], [], 0
    if texts:
        yield rows, texts


def _by_document(k: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
    """Documents, each with the list of its runs. A run is one number: first window, distance of the minimizer from there, windows."""
    order = np.lexsort((runs, k))
    k, runs = k[order], runs[order]
    fresh = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (runs[1:] != runs[:-1])))[: len(k)])
    k, runs = k[fresh], runs[fresh]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(k)), pa.int32()), pa.array(runs, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(k[first], pa.int64()), lists], schema=_MARKS)


def _packed(k: np.ndarray, runs: np.ndarray, hashes: np.ndarray) -> bytes:
    """Extensions of one bucket, by document and run."""
    named, doc = np.unique(k, return_inverse=True)
    columns = (hashes.astype(np.uint32), np.diff(doc, prepend=0).astype(np.uint32), np.diff(runs, prepend=0))
    raw = b"".join([len(named).to_bytes(8, "little"), named.tobytes(), *(c.tobytes() for c in columns)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What was packed: documents, runs, hashes."""
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    named = int.from_bytes(raw[:8], "little")
    n, at = (len(raw) - 8 - 8 * named) // 16, 8 + 8 * named
    hashes, doc, runs = (np.frombuffer(raw, t, n, at + skip * n) for t, skip in ((np.uint32, 0), (np.uint32, 4), (np.int64, 8)))
    return np.frombuffer(raw, np.int64, named, 8)[np.cumsum(doc, dtype=np.uint32)], np.cumsum(runs), hashes


def _sent(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Extensions (document, run, hash) of a batch in their buckets, each once; the runs of those that the batch has twice go with them."""
    if not held:
        return
    k, runs, h = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(h)
    k, runs, h = k[order], runs[order], h[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
    times = np.diff(np.append(start, len(h)))
    twice = np.repeat(times > 1, times)
    known = _by_document(k[twice], runs[twice])
    yield pa.RecordBatch.from_arrays([pa.array(np.abs(known.column(0).to_numpy() % buckets), pa.int32()), *known.columns, pa.nulls(known.num_rows, pa.binary())], schema=_SENT)
    # No run: the batch's own are known already, and the hash only tells others.
    k, runs, h = k[start], np.where(times > 1, 0, runs[start]), h[start]
    bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((runs, k, bucket))
    k, runs, h, bucket = k[order], runs[order], h[order], bucket[order]
    start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(h)])
    packed = [_packed(k[a:b], runs[a:b], h[a:b]) for a, b in zip(start.tolist(), np.append(start[1:], len(h)).tolist(), strict=True)]
    none = pa.nulls(len(start), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int32()), pa.nulls(len(start), pa.int64()), none, pa.array(packed, pa.binary())], schema=_SENT)


def _marked(docs: DataFrame, kind: Symbols) -> DataFrame:
    """(k, runs): runs with an extension that stands in two places. docs: (k, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], set(), 0
        for batch in batches:
            for rows, texts in _groups(batch, kind):
                fresh = [n for n, (k,) in enumerate(rows) if not (k in seen or seen.add(k))]  # equal rows are one document
                texts = [texts[n] for n in fresh]
                if not texts:
                    continue
                found = Batch(kind, texts)
                first, count, place, run, h = found.runs(kind)
                text = np.searchsorted(found.stops, first)
                origin = np.concatenate(([0], found.stops[:-1] + 1))[text]
                keys = np.array([rows[n][0] for n in fresh], np.int64)[text]
                number = (first - origin) << 20 | (place - first) << 8 | count
                held.append((keys[run], number[run], h))
                size += sum(map(len, texts))
                if size > TOGETHER:
                    yield from _sent(held, buckets)
                    held, seen, size = [], set(), 0
        yield from _sent(held, buckets)

    def settle(k: list, runs: list, h: list) -> pa.RecordBatch:
        k, runs, h = np.concatenate(k), np.concatenate(runs), np.concatenate(h)
        order = np.argsort(h)
        start = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        times = np.diff(np.append(start, len(h)))
        met = order[np.repeat(times > 1, times)]
        met = met[runs[met] != 0]
        return _by_document(k[met], runs[met])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column(1)))
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(2)], schema=_MARKS)
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if packed.is_valid:
                    if held and bucket != at:
                        yield settle(*zip(*held, strict=True))
                        held = []
                    at = bucket
                    held.append(_unpacked(packed.as_py()))
        if held:
            yield settle(*zip(*held, strict=True))

    sent = map_arrow(docs, send, "bucket int, k long, runs array<long>, packed binary")
    return map_arrow(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket"), count, "k long, runs array<long>")


def _first_copies(rows: list[tuple]) -> tuple[list, list]:
    """Splits (m, segment, __id, __h, start, windows) into first copies and the others."""
    first: dict[bytes, tuple] = {}
    others = []
    for row in rows:
        had = first.get(row[1])
        if had is None or row[2:5] < had[2:5]:
            first[row[1]] = row
            row = had
        if row is not None and row[2:5] != first[row[1]][2:5]:
            others.append(row)
    return list(first.values()), others


def _emit(first: list, others: list, width: int) -> pa.RecordBatch:
    """Segments to index, then spans that repeat outright (without m and segment)."""
    rows = [*first, *((None, None, i, h, at, n + width - 1) for _, _, i, h, at, n in others)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUTS, strict=True)], schema=_CUTS)


def _cut(met: DataFrame, kind: Symbols) -> DataFrame:
    """Segments of marked runs, copies too. met: (__id, __h, runs, text)."""

    def columns(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if f.type == pa.int64() else [x for part in c for x in part], f.type) for c, f in zip(zip(*held, strict=True), _CUTS, strict=True)], schema=_CUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for given, texts in _groups(batch, kind):
                for (i, h, runs), text in zip(given, texts, strict=True):
                    begin, end = kind.bounds(text + b"\x00")
                    number = np.unique(np.array(runs, np.int64))
                    first, ahead, count = number >> 20, number >> 8 & 0xFFF, number & 0xFF
                    inside = first + count + kind.window - 2 < len(end) - 1  # a key's namesake may have other runs
                    first, ahead, count = first[inside], ahead[inside], count[inside]
                    a, b = begin[first].tolist(), end[first + count + kind.window - 2].tolist()
                    c, d = begin[first + ahead].tolist(), end[first + ahead + kind.gram - 1].tolist()
                    grams = np.fromiter((xxhash.xxh3_64_intdigest(text[x:y]) for x, y in zip(c, d, strict=True)), np.uint64, len(c)).view(np.int64)
                    held.append((grams, [text[x:y] for x, y in zip(a, b, strict=True)], np.full(len(a), i), np.full(len(a), h), first, count))
                    size += len(text)
                    if size > TOGETHER:
                        yield columns(held)
                        held, size = [], 0
        if held:
            yield columns(held)

    return map_arrow(met.select("__id", "__h", "runs", "text"), run, "m long, segment binary, __id long, __h long, start long, size long")


def _dealt(crowded: DataFrame, kind: Symbols) -> DataFrame:
    """Segments of crowded minimizers as single windows, each sent by its own hash; spans of all but a batch's first copies.

    A crowd may hold a third of all rows, and copies of one text may be all of it. Equal segments of a batch leave one here, and equal windows
    too, so that what is sent of a text grows with the batches and not with its copies.
    """

    def deal(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        segments, others = _first_copies(held)
        yield _emit([], others, kind.window)
        rows = []
        for _, segment, i, h, start, size in segments:
            begin, end = kind.bounds(segment + b"\x00")
            for n in range(size):
                part = segment[begin[n] : end[n + kind.window - 1]]
                rows.append((xxhash.xxh3_64_intdigest(part) - (1 << 63), part, i, h, start + n, 1))
            if len(rows) > 200_000:
                yield _emit(*_first_copies(rows), kind.window)
                rows = []
        yield _emit(*_first_copies(rows), kind.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[1])
                if size > TOGETHER:
                    yield from deal(held)
                    held, size = [], 0
        yield from deal(held)

    return map_arrow(crowded.select(*_CUTS.names), run, "m long, segment binary, __id long, __h long, start long, size long")


def repeated_windows(kind: Symbols, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of windows that also start earlier among the segments, which come in the order of the corpus."""
    numbers: dict[bytes, int] = {}
    text = np.fromiter((numbers.setdefault(s, len(numbers)) for s in segments), np.int64, len(segments))
    return repeats_among(kind, list(numbers), text)


def repeats_among(kind: Symbols, texts: list[bytes], text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of segments given by their texts, which are numbered as they first appear.

    The index holds all segments, equal ones too. What it tells of a text holds wherever that text stands, so each text streams once, and
    all segments of it compare their own place with the earliest place that the index gives.
    """
    times = np.bincount(text, minlength=len(texts))
    members = np.argsort(text, kind="stable")
    lead = np.cumsum(times) - times
    symbols, sizes = kind.coded(texts)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    index = kind.index(symbols, kind.window, np.repeat(times, sizes + 1))

    def judged(which: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        earliest = index.earliest(group)
        home = np.searchsorted(ends, earliest)
        count = times[which]
        member = members[np.repeat(lead[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        first, ahead, into = (np.repeat(x, count) for x in (members[lead[home]], earliest - begins[home], at - begins[which]))
        late = (first < member) | (first == member) & (ahead < into)
        return member[late], into[late]

    found, told, waiting = [], [], 0
    for step in index.stream(symbols, begins, ends):
        told.append(step)
        waiting += int(times[step[0]].sum())
        if waiting > AT_ONCE >> 2:
            found.append(judged(*map(np.concatenate, zip(*told, strict=True))))
            told, waiting = [], 0
    if told:
        found.append(judged(*map(np.concatenate, zip(*told, strict=True))))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _merged(rows: np.ndarray, which: np.ndarray, offset: np.ndarray, width: int) -> pa.RecordBatch:
    """Spans of windows of ``width`` that overlap or touch, in segments. rows: (id, hash, start) of each segment."""
    places = np.sort(which << 9 | offset)  # a segment has no more than MOST_WINDOWS windows
    which, offset = places >> 9, places & 0x1FF
    first = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + width)))[: len(places)])
    last = np.append(first[1:], len(places))[: len(first)] - 1
    ids, hs, starts = rows[:, which[first]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, hs, starts + offset[first], offset[last] + width - offset[first])], schema=_SPANS)


def _indexed(segments: DataFrame, kind: Symbols) -> DataFrame:
    """Spans of repeated windows, found in blocks of whole minimizers."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(held).combine_chunks()
        places = np.stack([block.column(c).to_numpy() for c in ("__id", "__h", "start")])
        segments = block.column("segment").combine_chunks()
        segments = (segments.chunk(0) if isinstance(segments, pa.ChunkedArray) else segments).dictionary_encode()
        order = np.lexsort(places[::-1])
        places, text = places[:, order], segments.indices.to_numpy()[order]
        fresh = np.concatenate(([True], (places[:, 1:] != places[:, :-1]).any(axis=0)))  # equal rows are one document
        places, text = places[:, fresh], text[fresh]
        values, first, text = np.unique(text, return_index=True, return_inverse=True)
        rank = np.argsort(first)  # texts by their first place in the corpus
        number = np.empty(len(rank), np.int64)
        number[rank] = np.arange(len(rank))
        return _merged(places, *repeats_among(kind, segments.dictionary.take(pa.array(values[rank])).to_pylist(), number[text]), kind.window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole, at = [], 0, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            m, long = batch.column(0).to_numpy(), batch.column(5).to_numpy() + kind.window
            codes = batch.column(1).dictionary_encode().indices.to_numpy()
            new = np.zeros(n, np.int64)
            once = np.unique(codes, return_index=True)[1]
            new[once] = long[once]
            sizes, wholes = (np.concatenate(([0], np.cumsum(x))) for x in (new, long))
            starts = np.flatnonzero(np.concatenate(([m[0] != at], m[1:] != m[:-1])))
            at, begin = m[-1], 0
            while True:
                full = min(np.searchsorted(sizes, sizes[begin] + BLOCK - size, "right"), np.searchsorted(wholes, wholes[begin] + WITH_COPIES - whole, "right"))
                cut = np.searchsorted(starts, max(full, begin))
                if cut == len(starts):
                    break
                cut = int(starts[cut])
                if cut > begin:
                    held.append(batch.slice(begin, cut - begin))
                if held:
                    yield solve(held)
                held, size, whole, begin = [], 0, 0, cut
            held.append(batch.slice(begin))
            size, whole = size + int(sizes[n] - sizes[begin]), whole + int(wholes[n] - wholes[begin])
        if held:
            yield solve(held)

    return map_arrow(segments.repartition("m").sortWithinPartitions("m"), run, "__id long, __h long, start long, size long")


def find_repeats(docs: DataFrame, kind: Symbols, scratch: Scratch) -> DataFrame:
    """(__id, __h, start, size): spans of symbols that repeated windows cover. docs: with row_keys.

    Spans of one document may overlap.
    """
    # Texts of fewer bytes than a window has symbols hold none.
    texts = docs.where(F.octet_length("text") >= kind.window).select("__id", "__h", F.xxhash64("__id", "__h").alias("k"), "text")
    marks = scratch.save(_marked(texts.select("k", "text"), kind), "marks")
    runs = marks.groupBy("k").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    cuts = scratch.save(_cut(texts.join(runs.hint("merge"), "k"), kind), "cuts")
    segments = cuts.where("m is not null")
    crowded = segments.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("m")
    crowded = scratch.save(crowded, "crowded")
    if not crowded.isEmpty():
        hot, calm = split_by_marks(segments.withColumn("_k", F.col("m")), mark_words(crowded, "m"), "_k")
        windows = scratch.save(_dealt(hot.drop("_k"), kind), "windows")
        segments = calm.drop("_k").unionByName(windows.where("m is not null"))
        cuts = cuts.unionByName(windows.where("m is null"))
    return cuts.where("m is null").select("__id", "__h", "start", "size").unionByName(_indexed(segments, kind))


def with_spans(docs: DataFrame, kind: Symbols, scratch: Scratch) -> DataFrame:
    """The documents with row_keys and ``spans``, an array of (start, size), or null where nothing repeats."""
    keyed = row_keys(docs)
    found = find_repeats(keyed, kind, scratch).groupBy("__id", "__h").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    found = scratch.save(found, "spans")
    for name in ("marks", "cuts", "crowded", "windows"):
        scratch.drop(name)
    touched, rest = split_by_marks(keyed, mark_words(found, "__h"))
    none = F.lit(None).cast("array<struct<start:long,size:long>>")
    return touched.join(found.hint("merge"), ["__id", "__h"], "left").unionByName(rest.withColumn("spans", none))


def covered(spans: list | None, n: int) -> np.ndarray:
    """Which of n symbols the spans cover."""
    change = np.zeros(n + 1, np.int64)
    for s in spans if spans is not None else ():
        change[s["start"]] += 1
        change[s["start"] + s["size"]] -= 1
    return np.cumsum(change[:-1]) > 0
