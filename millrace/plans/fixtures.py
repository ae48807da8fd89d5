"""Small literal inputs for the advisors, whose telemetry no table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Polls of the statement log.
CYCLES = 7
#: (cycle, queryid, query, calls): cumulative calls of statements at each poll, which stay as they are after the last one given.
STATEMENTS = [
    (cycle, queryid, query, calls[min(cycle, len(calls) - 1)])
    for queryid, query, calls in (
        (1, "SELECT * FROM users WHERE users.country = $1", (5, 20, 45, 45)),
        (2, "select id from products where products.price >= $1 AND products.price not   like $2", (100, 130, 3, 60)),
        (3, "INSERT INTO events (id) VALUES ($1) ON CONFLICT DO NOTHING", (0, 500, 900, 900)),
        (4, "UPDATE users SET country = $1 WHERE users.id = $2", (1, 2, 3, 4)),
        (5, "SELECT * FROM events WHERE events.user_id = $1 AND events.kind IN $2", (10, 40, 70, 110)),
        (6, "VACUUM", (1, 1, 1, 1)),
        (7, 'SELECT x FROM "tiny" WHERE tiny.flag = $1', (0, 30, 60, 90)),
        (8, "DELETE FROM public.carts WHERE carts.id = $1", (3, 9, 9, 12)),
        (9, "/* report */ SELECT 1 FROM users WHERE users.name ILIKE $1 -- and users.email = $2", (0, 25, 50, 75, 100, 125, 150)),
        (10, "-- by price\nSELECT 1 FROM lots WHERE lots.price BETWEEN $1 AND $2 AND lots.kind NOT IN $3", (0, 12, 24, 36)),
    )
    for cycle in range(CYCLES)
]
#: (cycle, table, column) of actions that fail: a first creation, and a drop once.
FAILURES = [(1, "users", "name"), (6, "users", "country")]
#: (table, column, rows, distinct_ratio), and indexes that exist.
STATISTICS = [("users", "country", 1000, 0.2), ("products", "price", 500, 0.9), ("events", "user_id", 9000, 0.5), ("tiny", "flag", 5, 0.5)]
INDEXES = [("auto_idx_hash_users_country",)]


def values(rows: list[tuple]) -> str:
    """Rows as SQL values."""

    def shown(v: object) -> str:
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATEMENTS, "cycle int, queryid long, query string, calls long")


def statistics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATISTICS, "table string, column string, rows long, distinct_ratio double")


def failures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*f, False) for f in FAILURES], "cycle int, table string, column string, ok boolean")


def indexes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDEXES, "index string")
