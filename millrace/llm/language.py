"""Language identification by compression with per-language dictionaries.

Each language has a raw-content zstandard dictionary made of whole labelled texts. A text is
encoded with every dictionary, piece by piece, and the language of the smallest encoding wins.
A margin below ``min_margin`` between the two smallest encodings means rejection.

Defined cases: a null text or one without letters has language ``und``, score 0 and is rejected;
with no labelled text at all every document is ``und``; one learned language only gives score 1;
equal sizes fall to the most frequent of the learned languages with score 0. Columns of the input other than
the id and the text (and, in training, the label) never influence a result. Repeated rows are
answered each for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.workers import map_pandas
from millrace.llm.common import crc_bucket, table, whole_texts

#: Bounds of the training sample: texts for each language, and bytes of each dictionary.
SAMPLE_TEXTS, DICTIONARY_BYTES = 300, 64 << 10
#: Bytes encoded at once. Short pieces lean on the dictionary, not on the text before them.
PIECE_BYTES = 4096
LEVEL = 6
#: The least relative difference of the two smallest encodings.
MIN_MARGIN = 0.004
#: The margin at which the score is one half.
HALF_MARGIN = 0.02

_LETTER = regex.compile(r"\p{L}")


def learn_dictionaries(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionaries from a bounded sample of labelled rows (doc_id, text, lang).

    The sample takes, for each label, the ``sample_texts`` rows whose hashed id is smallest and
    fills ``dictionary_bytes`` with lower-cased texts in that order (the last one may be cut).
    Languages come by falling frequency. Ids are chosen before
    any text is read, so that no more than the sample leaves the executors.
    """
    order = F.xxhash64(F.col("doc_id"))
    keyed = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", order.alias("order"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id")))
    chosen = [r.doc_id for r in ranked.where(F.col("rank") <= sample_texts).select("doc_id").distinct().collect()]
    if not chosen:
        return {}
    rows = labelled.where(F.col("doc_id").isin(chosen) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    texts: dict[str, list[str]] = {}
    frequent = [r.lang for r in keyed.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    bounded = rows.select("lang", order.alias("order"), F.substring("text", 1, dictionary_bytes).alias("text"))
    for r in bounded.orderBy("lang", "order", "text").toLocalIterator():
        texts.setdefault(r.lang, []).append(r.text)
    learned = {}
    for lang in (x for x in frequent if x in texts):
        content = b""
        for text in texts[lang]:
            if len(content) >= dictionary_bytes:
                break
            content += text.lower().encode("utf-8", "replace") + b"\n"
        if len(content) >= 8 and regex.search(_LETTER, content.decode("utf-8", "replace")):
            learned[lang] = content[:dictionary_bytes]
    return learned


class Classifier:
    """Encoders with one dictionary each; a text's language is that of the smallest encoding."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.encoders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        """Bytes of the text's encoding for each language."""
        raw = text.lower().encode("utf-8", "replace")
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(e.compress(p)) for p in pieces) for e in self.encoders]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and the margin of the two smallest encodings."""
        if not self.langs or text is None or not _LETTER.search(text):
            return "und", 0.0, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0
        sizes = self.sizes(text)
        best, second = sorted(sizes)[:2]
        margin = (second - best) / second
        return self.langs[sizes.index(best)], margin / (margin + HALF_MARGIN), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``score``, ``margin`` and ``rejected`` to (doc_id, text, ...).

    Columns of these names in the input are replaced. ``rejected``: no letters, or a margin below ``min_margin``.
    """
    kept = docs.drop("lang_pred", "score", "margin", "rejected")
    schema = T.StructType(list(kept.schema.fields)).add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = [classifier.classify(t) for t in batch["text"]]
            yield batch.assign(
                lang_pred=[x[0] for x in found],
                score=[x[1] for x in found],
                margin=[x[2] for x in found],
                rejected=[x[0] == "und" or x[2] < min_margin for x in found],
            )

    return map_pandas(kept, run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from: crc32(doc_id as text) mod 4 is not 2."""
    return whole_texts(docs, "lang").where(crc_bucket(F.col("doc_id")) != 2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, with the held-out flag of its id."""
    docs = table(spark, sf_dir, "documents")
    found = identify(whole_texts(docs), learn_dictionaries(training_rows(docs)))
    return found.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")
