"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token weights of cells (source, language, topic) are raked until their sums agree with target shares of each
dimension; every document of a cell is then kept with the cell's probability, scaled so that the expected tokens meet the budget
with no probability above one. All work on rows is DataFrame expressions; sources stay distributed, and only sums
by language and topic (as many as those two have levels) reach the driver.

A topic column may be given. Without one, the topic is the register that a text's surface shows: figures, lists, notes,
essays or prose, of its whole text.

Defined cases: null source, language or topic are the level ``(none)``; null and empty texts have no tokens, so their cell
may have no weight, and they are kept with the probability of other texts of the cell, or never if it has none; rows with equal ids
share one decision; a null id is decided like the text ``(none)``; an empty table gives an empty result; more than ``MOST_PAIRS`` pairs of
language and topic are an error, and call for a coarser topic. Other
columns pass through (those named like the added ones are replaced).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, table

NONE = "(none)"
#: Most rounds of raking and rounds of fitting the scale, share of tokens kept, exponent of default targets.
ROUNDS, SCALE_ROUNDS, KEEP, TEMPER = 12, 6, 0.5, 0.5
#: Raking ends once no language's or topic's factor moves by more than this part of itself.
SETTLED = 1e-9
#: Languages times topics at most: their sums and factors pass through the driver, whose plan holds them as literals.
MOST_PAIRS = 10_000
ADDED = ("topic", "n_words", "probability", "kept", "raking_error")


def words(text: Column) -> Column:
    """Words of a text, cut at ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def register(text: Column, n_words: Column) -> Column:
    """What a whole text looks like: figures, list, note, essay or prose."""
    digits = F.length(text) - F.length(F.translate(text, "0123456789", ""))
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return (
        F.when(digits * 25 > F.length(text), "figures")
        .when(n_words < lines * 8, "list")
        .when(n_words < 100, "note")
        .when(n_words >= 1000, "essay")
        .otherwise("prose")
    )


def cells_of(docs: DataFrame, topic: str | None = None) -> DataFrame:
    """Adds ``__source``, ``__lang``, ``topic`` and ``n_words`` to the documents."""
    kept = docs.drop(*(c for c in ADDED if c != topic)).withColumn("n_words", words(F.col("text")))
    kind = F.col(topic).cast("string") if topic else register(F.coalesce(F.col("text"), F.lit("")), F.col("n_words"))
    return kept.withColumn("topic", F.coalesce(kind, F.lit(NONE))).withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit(NONE))).withColumn("__lang", F.coalesce(F.col("lang").cast("string"), F.lit(NONE)))


def _tempered(totals: Mapping[str, float], given: Mapping[str, float] | None) -> dict[str, float]:
    """Target shares: those given, or the totals' powers, scaled to one."""
    raw = {k: (given.get(k, 0.0) if given is not None else (v**TEMPER if v else 0.0)) for k, v in totals.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def _dot(weights: Column, factors: list[float]) -> Column:
    """Sum of products of a row's weights with factors."""
    return F.aggregate(F.zip_with(weights, F.array(*map(F.lit, factors)), lambda w, f: w * f), F.lit(0.0), lambda a, x: a + x)


def rake(cells: DataFrame, scratch: Scratch, sources: Mapping[str, float] | None = None, langs: Mapping[str, float] | None = None, topics: Mapping[str, float] | None = None, rounds: int = ROUNDS, keep: float = KEEP) -> tuple[DataFrame, dict[tuple[str, str], float], float]:
    """Sampling rates from cells (__source, __lang, topic, weight).

    Gives (__source, rate), a rate for each (language, topic) - their product, cut at one, is the cell's probability - and the marginal
    error: by how much the factors still moved in the last round, relative to themselves.
    """
    cells = scratch.save(cells, "cells")
    sums = cells.groupBy("__lang", "topic").agg(F.sum("weight").alias("w")).limit(MOST_PAIRS + 1)
    pairs = sorted((r["__lang"], r.topic, float(r.w)) for r in sums.collect())
    if len(pairs) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of language and topic")
    if not pairs:
        return cells.select("__source", F.lit(0.0).alias("__rate")), {}, 0.0
    by_lang, by_topic = ({k: sum(p[2] for p in pairs if p[at] == k) for k in sorted({p[at] for p in pairs})} for at in (0, 1))
    want_lang, want_topic = _tempered(by_lang, langs), _tempered(by_topic, topics)
    place = F.create_map(*(F.lit(x) for n, p in enumerate(pairs) for x in (f"{p[0]}\x1f{p[1]}", n)))
    keyed = cells.select("__source", F.element_at(place, F.concat_ws("\x1f", "__lang", "topic")).alias("at"), F.col("weight").cast("double").alias("w"))
    entries = F.map_from_entries(F.collect_list(F.struct("at", "w")))
    rows = keyed.groupBy("__source").agg(entries.alias("m"), F.sum("w").alias("total"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(len(pairs) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    if sources is None:
        wanted = F.pow("total", F.lit(TEMPER))
    else:
        wanted = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in sources.items() for x in (k, float(v)))), F.col("__source")), F.lit(0.0)) if sources else F.lit(0.0)
    rows = scratch.save(rows.select("__source", weights.alias("w"), wanted.alias("wanted")), "sources")
    scale = rows.agg(F.sum("wanted")).first()[0] or 1.0
    total = sum(p[2] for p in pairs)
    of_lang, of_topic = dict.fromkeys(by_lang, 1.0), dict.fromkeys(by_topic, 1.0)

    def source_factor() -> Column:
        met = _dot(F.col("w"), [of_lang[p[0]] * of_topic[p[1]] for p in pairs])
        return F.when(met > 0, F.col("wanted") / scale / met).otherwise(F.lit(0.0))

    factor, moved = source_factor(), 0.0
    for _ in range(rounds):
        factor, were = source_factor(), (dict(of_lang), dict(of_topic))
        spread = rows.withColumn("f", factor).select(F.posexplode(F.transform("w", lambda x: x * F.col("f"))).alias("at", "x"))
        met = {r["at"]: r["x"] for r in spread.groupBy("at").agg(F.sum("x").alias("x")).collect()}
        for k in of_lang:
            got = sum(met[n] * of_topic[p[1]] for n, p in enumerate(pairs) if p[0] == k)
            of_lang[k] = want_lang[k] / got if got else 0.0
        for k in of_topic:
            got = sum(met[n] * of_lang[p[0]] for n, p in enumerate(pairs) if p[1] == k)
            of_topic[k] = want_topic[k] / got if got else 0.0
        moved = max(abs(now[k] / was[k] - 1) if was[k] else abs(now[k]) for now, was in zip((of_lang, of_topic), were, strict=True) for k in now)
        if moved < SETTLED:
            break
    budget, up = keep * total, 1.0
    raked = [of_lang[p[0]] * of_topic[p[1]] for p in pairs]
    fitted = rows.withColumn("f", factor).select(F.col("f"), F.posexplode("w").alias("at", "x")).withColumn("g", F.col("f") * F.element_at(F.array(*map(F.lit, raked)), F.col("at") + 1) * budget)
    fitted = scratch.save(fitted.select("x", "g"), "fitted")
    for _ in range(SCALE_ROUNDS):
        over = F.col("g") * up >= 1
        r = fitted.agg(F.sum(F.when(over, F.col("x")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("x") * F.col("g"))).alias("part")).first()
        if r.part and r.part > 0 and budget > r.full:
            up = (budget - r.full) / r.part
    return rows.select("__source", (factor * (budget * up)).alias("__rate")), {(p[0], p[1]): f for p, f in zip(pairs, raked, strict=True)}, moved


def draw(doc_id: Column, salt: str = "mix") -> Column:
    """A number in [0, 1) that an id always draws."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit(NONE)), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, scratch: Scratch, topic: str | None = None, **targets) -> DataFrame:
    """The documents with ``topic``, ``n_words``, ``probability``, ``kept`` and ``raking_error``.

    The last is one value: by how much of itself some factor still moved in the last round. Above ``SETTLED``, the shares are off by about as much.
    """
    marked = cells_of(docs, topic)
    cells = marked.groupBy("__source", "__lang", "topic").agg(F.sum("n_words").alias("weight"))
    rates, pairs, moved = rake(cells, scratch, **targets)
    of_pair = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for (a, b), f in pairs.items() for x in (f"{a}\x1f{b}", f))), F.concat_ws("\x1f", "__lang", "topic")), F.lit(0.0)) if pairs else F.lit(0.0)
    # Sources are as few or many as the data has: Spark broadcasts their rates only if their size allows.
    met = marked.join(rates, "__source", "left")
    p = F.least(F.lit(1.0), F.coalesce(F.col("__rate"), F.lit(0.0)) * of_pair)
    return met.withColumn("probability", p).withColumn("kept", draw(F.col("doc_id")) < F.col("probability")).withColumn("raking_error", F.lit(float(moved))).drop("__source", "__lang", "__rate")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, sampling probability and decision."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, Scratch(spark, "mixing")).select("doc_id", "source", "lang", "topic", "n_words", F.round("probability", 6).alias("probability"), "kept")


def _oracle() -> str:
    """The same in SQL: one common table for each factor of each round."""
    words_sql = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
    parts = [
        f"d AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(text, '') AS text, {words_sql}::BIGINT AS n_words FROM documents)",
        """f AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l, n_words,
  CASE WHEN (length(text) - length(translate(text, '0123456789', ''))) * 25 > length(text) THEN 'figures'
       WHEN n_words < (length(text) - length(replace(text, chr(10), '')) + 1) * 8 THEN 'list'
       WHEN n_words < 100 THEN 'note' WHEN n_words >= 1000 THEN 'essay' ELSE 'prose' END AS t FROM d)""",
        "c AS MATERIALIZED (SELECT s, l, t, sum(n_words)::DOUBLE AS w FROM f GROUP BY ALL)",
    ]
    for k in "slt":
        parts.append(f"want_{k} AS MATERIALIZED (SELECT {k}, pow(sum(w), {TEMPER}) / sum(pow(sum(w), {TEMPER})) OVER () AS want FROM c GROUP BY {k})")
    parts += [f"{k}0 AS MATERIALIZED (SELECT {k}, 1.0::DOUBLE AS {k}f FROM want_{k})" for k in "lt"]
    for n in range(1, ROUNDS + 1):
        for k, others in (("s", [("l", n - 1), ("t", n - 1)]), ("l", [("s", n), ("t", n - 1)]), ("t", [("s", n), ("l", n)])):
            joins = " ".join(f"JOIN {o}{m} USING ({o})" for o, m in others)
            product = " * ".join(f"{o}f" for o, _ in others)
            parts.append(f"{k}{n} AS MATERIALIZED (SELECT {k}, CASE WHEN sum(w * {product}) > 0 THEN any_value(want) / sum(w * {product}) ELSE 0 END AS {k}f FROM c {joins} JOIN want_{k} USING ({k}) GROUP BY {k})")
    parts.append(f"g AS MATERIALIZED (SELECT s, l, t, w, sf * lf * tf * {KEEP} * (SELECT sum(w) FROM c) AS g FROM c JOIN s{ROUNDS} USING (s) JOIN l{ROUNDS} USING (l) JOIN t{ROUNDS} USING (t))")
    parts.append("u0 AS MATERIALIZED (SELECT 1.0::DOUBLE AS u)")
    for n in range(1, SCALE_ROUNDS + 1):
        full, part = "sum(CASE WHEN g * u >= 1 THEN w ELSE 0 END)", "sum(CASE WHEN g * u >= 1 THEN 0 ELSE w * g END)"
        parts.append(f"u{n} AS MATERIALIZED (SELECT CASE WHEN {part} > 0 AND {KEEP} * sum(w) > {full} THEN ({KEEP} * sum(w) - {full}) / {part} ELSE any_value(u) END AS u FROM g, u{n - 1})")
    parts.append(f"p AS MATERIALIZED (SELECT s, l, t, least(1.0, g * u) AS p FROM g, u{SCALE_ROUNDS})")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, t AS topic, n_words, round(p, 6) AS probability, "
        "(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '(none)') || ':mix'), 1, 8))::BIGINT / 4294967296.0) < p AS kept FROM f JOIN p USING (s, l, t)"
    )


ORACLE = _oracle()
