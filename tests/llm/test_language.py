import itertools
import random
import zlib

import zstandard
from pyspark.sql import functions as F

from millrace.llm import language
from millrace.llm.language import Classifier, identify, learn_dictionaries, training_rows

WORDS = {"xa": "alpha beta gamma delta ", "xb": "uno due tre quattro cinque ", "xc": "eins zwei drei vier "}


def test_languages_of_held_out_texts(spark):
    rows = [(i, (w * 20)[i % 7 :], lang) for i, (lang, w) in enumerate([*WORDS.items()] * 20)]
    docs = spark.createDataFrame([*rows, (900, None, "xa"), (901, "123 !!", "xb"), (902, "alpha", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in identify(docs, learn_dictionaries(training_rows(docs))).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows)
    assert found[900].lang_pred == found[901].lang_pred == "und" and found[900].rejected and found[901].score == 0
    assert all(0 <= r.score <= 1 for r in found.values())


def test_training_leaves_out_held_out_rows(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("x").alias("lang"))
    assert sorted(r.doc_id for r in training_rows(docs).collect()) == [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]


def babble(rng, pairs, n):
    """Text of a made language: syllables that follow each other by the language's own pairs."""
    out, at = [], rng.choice([*pairs])
    for _ in range(n):
        out.append(at + rng.choice(("", "", " ")))
        at = rng.choice(pairs[at])
    return "".join(out)


def test_held_out_texts_against_plain_compression(spark):
    rng = random.Random(11)
    syllables = ["".join(p) for p in itertools.product("bdgklmnprst", "aeiou")]
    tongues = {name: {s: rng.sample(syllables, 4) for s in syllables} for name in ("xa", "xb", "xc", "xd")}
    rows = [(i, babble(rng, tongues[lang], rng.randint(40, 900)), lang) for i, lang in enumerate(rng.choices([*tongues], k=240))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = learn_dictionaries(training_rows(docs), 60, 16 << 10)
    found = {r.doc_id: r for r in identify(docs, learned).collect()}
    right = total = 0
    for i, text, lang in rows:
        # The size of each piece with a dictionary, from a fresh compressor each time.
        sizes = {}
        for name, content in learned.items():
            raw, sizes[name] = text.lower().encode(), 0
            for at in range(0, len(raw), language.PIECE_BYTES):
                made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[name] += len(packer.compress(raw[at : at + language.PIECE_BYTES]))
        best, second = sorted(sizes.values())[:2]
        assert sizes[found[i].lang_pred] == best and found[i].rejected == ((second - best) / second < language.MIN_MARGIN)
        if zlib.crc32(str(i).encode()) % 4 == 2:
            total += 1
            right += found[i].lang_pred == lang
    assert total > 40 and right / total > 0.95


def test_no_labels_and_empty_table(spark, awkward, empty):
    assert learn_dictionaries(training_rows(empty)) == {}
    assert {r.lang_pred for r in identify(awkward, {}).collect()} == {"und"}
    assert identify(empty, {"x": b"some text of a language"}).count() == 0


def test_narrow_margins_are_rejected():
    same = b"the same words for both of them " * 30
    assert Classifier({"a": same, "b": same}).classify("the same words")[2] == 0.0
