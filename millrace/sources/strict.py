"""Events from JSON text under a named policy for bad records, beside the tolerant reader that leaves them out.

A record is good if it is one JSON object (no second value, no trailing text, no single quotes), its fields have their declared types, and it
has a user, a product and a known type. ``mark`` keeps every record and tells why it is bad; ``fail`` ends with an error at the first bad one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.schemas import EVENT, EVENT_TYPES

_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def one_value(text: Column) -> Column:
    """Whether a text is exactly one JSON value: as an array's only element, and as a field before another one."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)
    held = F.from_json(F.concat(F.lit('{"e":'), text, F.lit(',"end":true}')), "e string, end boolean", {"allowSingleQuotes": "false"})
    return F.coalesce((F.size(listed) == 1) & held["end"], F.lit(False))


def checked(records: DataFrame) -> DataFrame:
    """Adds the event's fields and ``reason`` to records with a text column ``value``.

    reason: ``blank``, ``not_json``, ``wrong_type`` (a field is not of its type), ``missing`` or ``unknown_type``; null for a good record, and then only.
    """
    text = F.col("value").cast("string")
    parsed = records.withColumn("__e", F.from_json(text, f"{EVENT.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, __corrupt string", _STRICT))
    reason = (
        F.when(F.coalesce(F.trim(text, F.lit(" \t\r\n")), F.lit("")) == "", "blank")
        .when(~one_value(text) | ~F.coalesce(F.ltrim(text, F.lit(" \t\r\n")).startswith("{"), F.lit(False)), "not_json")
        .when(F.col("__e.__corrupt").isNotNull(), "wrong_type")
        .when(F.col("__e.user_id").isNull() | F.col("__e.product_id").isNull() | F.col("__e.event_type").isNull(), "missing")
        .when(~F.col("__e.event_type").isin(*EVENT_TYPES), "unknown_type")
    )
    return parsed.select(*records.columns, *(F.col(f"__e.{n}").alias(n) for n in EVENT.names), reason.alias("reason"))


def parse(records: DataFrame, policy: str = "mark") -> DataFrame:
    """Events under a policy: ``skip`` gives good ones, ``mark`` all with their reason, ``fail`` raises at a bad one."""
    found = checked(records)
    if policy == "mark":
        return found
    if policy == "skip":
        return found.where("reason IS NULL").drop("reason")
    if policy != "fail":
        raise ValueError(f"no policy {policy!r}")
    told = F.concat(F.lit("bad record ("), F.col("reason"), F.lit("): "), F.coalesce(F.col("value").cast("string"), F.lit("null")))
    return found.where(F.when(F.col("reason").isNotNull(), F.raise_error(told)).otherwise(F.lit(True)).cast("boolean")).drop("reason")
