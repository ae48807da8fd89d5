"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of its text. Each passage is encoded from its surface (frequencies of pairs of byte
classes, repeats of words and of runs of words); a gated attention, tanh(H V) * sigmoid(H U) against a vector, weighs the encodings, and the
weighted sum is judged. Only documents have labels: encoder, attention and judgement are learned together from them by gradient descent in numpy,
on the bounded sample below; Spark workers then score every document.

The sample takes, for each label, the ``SAMPLE`` labelled documents whose hashed id is smallest, and of a document with more than ``SAMPLE_PASSAGES``
passages so many at even distances; these bounds hold for learning only.

Defined cases: a null or empty text, or one of white space, is a bag of one passage without words, scored like any other; rows with equal texts score alike whatever
their ids, which may be null or repeated; a label that is null or neither 0 nor 1 is ignored, and so are ids labelled both ways; where labels of
either kind are missing, every score is the share of label 1 (one half without any). Very long texts are read in pieces of ``PIECE`` bytes: passages end
where a piece ends, and repeats are looked for within a piece. Columns other than id and text never influence a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.workers import map_arrow
from millrace.llm.common import crc_bucket, table, tidy, whole_texts

#: Words of a passage, bytes of a text read at once, words of a run whose repeats count.
PASSAGE, PIECE, RUN = 64, 1 << 20, 4
#: Documents of each label, and passages of each, that are learned from.
SAMPLE, SAMPLE_PASSAGES = 1500, 64
#: Width of an encoding and of the attention, rounds over the sample, documents of a step, rate, decay.
WIDTH, GATE, EPOCHS, STEP, RATE, DECAY = 32, 16, 30, 64, 3e-3, 1e-4
#: Score from which a document is predicted to be good.
GOOD = 0.7
#: Passages that a worker encodes at once.
AT_ONCE = 4096

_CLASSES = 16


def _byte_classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, blanks, line ends, frequent marks, groups of other marks, and beyond ASCII."""
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",;:", "!?", "'\"", "-_", "()[]{}<>", "#$%&*@^~", "|/\\+="]
    out = np.full(256, 13, np.int64)  # other control characters
    for n, g in enumerate(groups):
        out[[ord(c) for c in g]] = n
    out[128:192], out[192:] = 14, 15
    return out


CLASS = _byte_classes()
_BLANK = (CLASS == 3) | (CLASS == 4)
#: Features of a passage: pairs of classes, then fullness, length of words, and shares of different words, new words, words like the one before, new runs.
FEATURES = _CLASSES * _CLASSES + 6


def _first(hashes: np.ndarray) -> np.ndarray:
    """Where a value stands for the first time."""
    new = np.zeros(hashes.size, bool)
    new[np.unique(hashes, return_index=True)[1]] = True
    return new


def piece_features(raw: bytes) -> np.ndarray:
    """Features of the passages of one piece, a row each; none for blanks only."""
    words = raw.split()
    if not words:
        return np.zeros((0, FEATURES), np.float32)
    n = -(-len(words) // PASSAGE)
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    at = np.maximum(np.cumsum(starts) - 1, 0) // PASSAGE
    kinds = CLASS[data]
    pairs = np.bincount(at[:-1] * _CLASSES**2 + kinds[:-1] * _CLASSES + kinds[1:], minlength=n * _CLASSES**2).reshape(n, -1)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    where = np.arange(len(words)) // PASSAGE
    count = np.bincount(where, minlength=n)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(where[: flags.size], weights=flags, minlength=n) / count

    own = _first(hashes * np.uint64(0x9E3779B97F4A7C15) + where.astype(np.uint64))
    again = np.append(False, hashes[1:] == hashes[:-1])
    runs = hashes.copy()
    for k in range(1, min(RUN, runs.size)):
        runs[: runs.size - k] += hashes[k:] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * k)
    out = np.empty((n, FEATURES), np.float32)
    out[:, : _CLASSES**2] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1), 1)[:, None])
    lengths = np.bincount(where, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=n) / count
    out[:, _CLASSES**2 :] = np.column_stack([count / PASSAGE, np.log1p(lengths), share(own), share(_first(hashes)), share(again), share(_first(runs))])
    return out


def bags(raw: bytes) -> Iterator[np.ndarray]:
    """Features of all passages of a text (UTF-8), piece by piece; one row of zeros where there is no word."""
    at, met = 0, False
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):  # back to the last blank of the piece, if it has one
            cut = max(raw.rfind(b, at, end) for b in (b" ", b"\n", b"\t"))
            end = cut + 1 if cut > at else end
        found = piece_features(raw[at:end])
        if len(found):
            met = True
            yield found
        at = end
    if not met:
        yield np.zeros((1, FEATURES), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Attention:
    """Encoder, gated attention and judgement; ``p`` holds the parameters by name."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int = 7) -> Attention:
        rng = np.random.default_rng(seed)

        def drawn(*shape: int) -> np.ndarray:
            return rng.normal(size=shape) / np.sqrt(shape[0])

        p = {"w": drawn(x.shape[1], WIDTH), "b": np.zeros(WIDTH), "v": drawn(WIDTH, GATE), "u": drawn(WIDTH, GATE), "a": drawn(GATE, 1), "c": drawn(WIDTH, 1), "d": np.zeros(1)}
        return cls(p, x.mean(axis=0), x.std(axis=0) + 0.05)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encodings, both halves of the gate, and unscaled weights (bounded by the gate, so that exp is safe)."""
        h = np.tanh(((x - self.mean) / self.scale) @ self.p["w"] + self.p["b"])
        t, s = np.tanh(h @ self.p["v"]), _sigmoid(h @ self.p["u"])
        return h, t, s, np.exp((t * s) @ self.p["a"])[:, 0]

    def judge(self, z: np.ndarray) -> np.ndarray:
        """Scores of weighted encodings."""
        return _sigmoid(z @ self.p["c"] + self.p["d"])[:, 0]

    def gradients(self, x: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over bags, which begin at ``starts``."""
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        h, t, s, e = self.encode(x)
        weights = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weights[:, None] * h, starts)
        off = (self.judge(z) - labels) / len(labels)
        dz = np.repeat(off[:, None] * p["c"].T, sizes, axis=0)
        gain = (dz * h).sum(axis=1)
        dl = weights * (gain - np.repeat(np.add.reduceat(weights * gain, starts), sizes))
        gate = dl[:, None] * p["a"].T
        dv, du = gate * s * (1 - t * t), gate * t * s * (1 - s)
        dh = (weights[:, None] * dz + dv @ p["v"].T + du @ p["u"].T) * (1 - h * h)
        return {"w": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(axis=0), "v": h.T @ dv, "u": h.T @ du, "a": (t * s).T @ dl[:, None], "c": z.T @ off[:, None], "d": off.sum(keepdims=True)}


def fit(found: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Attention:
    """Learns from bags and their labels, both labels weighing alike, by Adam with decay."""
    model = Attention.fresh(np.concatenate(found), seed)
    rng, moments, steps = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}, 0
    sides = [np.flatnonzero(labels == k) for k in (0, 1)]
    half = max(map(len, sides))
    for _ in range(epochs):
        order = np.concatenate([rng.permutation(np.resize(rng.permutation(s), half)) for s in sides])
        for some in np.array_split(rng.permutation(order), -(-order.size // STEP)):
            starts = np.cumsum([0] + [len(found[i]) for i in some[:-1]])
            steps += 1
            for k, g in model.gradients(np.concatenate([found[i] for i in some]), starts, labels[some]).items():
                m, q = moments[k]
                m += 0.1 * (g - m)
                q += 0.001 * (g * g - q)
                model.p[k] -= RATE * (m / (1 - 0.9**steps) / (np.sqrt(q / (1 - 0.999**steps)) + 1e-8) + DECAY * model.p[k])
    return model


def _even(rows: np.ndarray, most: int) -> np.ndarray:
    """At most so many rows, at even distances."""
    return rows if len(rows) <= most else rows[np.linspace(0, len(rows) - 1, most).astype(int)]


def training_bags(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Passages and labels of the bounded sample. docs: (doc_id, text); labels: (doc_id, quality)."""
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = told.where("quality = other").drop("other").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    some = [known.where(F.col("quality") == k).orderBy(order, "doc_id").limit(sample) for k in (0, 1)]
    # So many rows at most: small enough to broadcast.
    chosen = F.broadcast(some[0].unionByName(some[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(1).to_pylist()):
                packed = _even(np.concatenate(list(bags(raw))), SAMPLE_PASSAGES).astype(np.float16).tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([packed])], ["doc_id", "quality", "bag"])

    texts = docs.join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("quality").cast("int").alias("quality"))
    packed = map_arrow(texts, run, "doc_id long, quality int, bag binary")
    found, answers = [], []
    with tidy(docs.sparkSession):
        for k in (0, 1):
            # Repeated ids bring more rows than were chosen: the sample's bound holds for rows too.
            rows = packed.where(F.col("quality") == k).orderBy(order, F.xxhash64("bag")).limit(sample).select("bag").toArrow()
            for b in rows["bag"].to_pylist():
                found.append(np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float64))
                answers.append(k)
    return found, np.array(answers, np.float64)


def score(docs: DataFrame, model: Attention | float) -> DataFrame:
    """(doc_id, score, n_passages) of every row of (doc_id, text); a number as the model is every row's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            num, den, count = np.zeros((n, WIDTH)), np.zeros(n), np.zeros(n, np.int32)
            held, whose, size = [], [], 0

            def flush() -> None:
                x, at = np.concatenate(held), np.repeat(np.array(whose), [len(p) for p in held])
                if isinstance(model, Attention):
                    h, _, _, e = model.encode(x)
                    np.add.at(num, at, e[:, None] * h)
                    np.add.at(den, at, e)
                np.add.at(count, at, 1)

            for i, raw in enumerate(batch.column(1)):
                for part in bags(memoryview(raw.as_buffer()).tobytes()):
                    held.append(part)
                    whose.append(i)
                    size += len(part)
                    if size >= AT_ONCE:
                        flush()
                        held, whose, size = [], [], 0
            if held:
                flush()
            scores = model.judge(num / den[:, None]) if isinstance(model, Attention) else np.full(n, float(model))
            # Nine digits: the last ones depend on which rows a batch holds.
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(scores, 9)), pa.array(count)], ["doc_id", "score", "n_passages"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return map_arrow(texts, run, "doc_id long, score double, n_passages int")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | float:
    """The model of labelled documents; a number if either label is missing."""
    found, answers = training_bags(docs, labels, sample)
    if not len(answers):
        return 0.5
    return float(answers.mean()) if answers.min() == answers.max() else fit(found, answers)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, with the held-out flag of its id."""
    docs = whole_texts(table(spark, sf_dir, "documents"))
    known = docs.where(crc_bucket(F.col("doc_id")) != 2)
    found = score(docs, learn(known, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return found.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), "n_passages")
