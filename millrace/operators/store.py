"""Catalog, users and search: filters, pages, geo distance and BM25."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import fresh_path

EARTH_KM = 6371.0088
K1, B = 1.2, 0.75
#: Fields of the full-text score with their boosts; tags match as whole strings only.
FIELDS: dict[str, float] = {"name": 2.0, "description": 1.0}
TOKENS = r"[^\p{L}\p{N}]+"


def page(rows: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    """A page of rows in order of their ids."""
    return rows.orderBy("id").offset(skip).limit(limit)


def by_country(users: DataFrame, country: str | None = None) -> DataFrame:
    """Users of a country; without one (or with an empty one) all."""
    return users.where(F.col("country") == country) if country else users


def by_id(rows: DataFrame, *ids: int) -> DataFrame:
    """The rows of the given ids; unknown ids give none."""
    return rows.where(F.col("id").isin(list(ids)))


def flat(products: DataFrame) -> DataFrame:
    """Products as search documents."""
    spot = F.col("location.coordinates")
    return products.select(
        "id", "name", "category", F.coalesce(F.col("specifications")["brand"], F.lit("")).alias("brand"), "price", "description", "tags",
        F.col("rating.average").alias("rating_average"), F.col("rating.count").alias("rating_count"),
        F.when(F.col("location").isNotNull(), F.struct(spot[1].alias("lat"), spot[0].alias("lon"))).alias("location"), "images", "asin",
    )


def distance_km(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat), F.radians(F.lit(to_lat))
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.lit(to_lon) - lon) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def matches(category: str | None = None, brand: str | None = None, price_min: float | None = None, price_max: float | None = None, rating_min: float | None = None, lat: float | None = None, lon: float | None = None, radius_km: float | None = None) -> Column:
    """The conjunction of the filters that are given; distance needs all three of its values."""
    parts = [F.lit(True)]
    parts += [F.col("category") == category] if category else []
    parts += [F.col("brand") == brand] if brand else []
    parts += [F.col("price") >= price_min] if price_min is not None else []
    parts += [F.col("price") <= price_max] if price_max is not None else []
    parts += [F.col("rating_average") >= rating_min] if rating_min is not None else []
    if lat is not None and lon is not None and radius_km is not None:
        # A degree of latitude is 111.19 km everywhere: the cheap bound goes first.
        parts.append(F.abs(F.col("location.lat") - lat) <= radius_km / 111.0)
        parts.append(distance_km(F.col("location.lat"), F.col("location.lon"), lat, lon) <= radius_km)
    return reduce(lambda a, b: a & b, parts)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKENS), lambda t: t != "")


def terms_of(query: str) -> list[str]:
    """The different terms of a query."""
    return sorted({t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()})


def _times(array: str, term: str) -> Column:
    """How often an array holds a term."""
    return F.size(F.filter(array, lambda x: x == term))


def term_weight(tf: Column, length: Column, n: int, average: float, df: int) -> Column:
    """What a term adds to the score of a text that holds it ``tf`` times."""
    idf = F.log(1 + (F.lit(n) - df + 0.5) / (F.lit(df) + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def bm25(rows: DataFrame, field: str, query: str) -> DataFrame:
    """(id, score): BM25 of a field over all rows; rows without a query term are left out.

    Texts are cut into words once; what stays of each is its length and how often it holds each term. For a corpus that is asked often, see ``postings``.
    """
    terms = terms_of(query)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    cut = rows.select("id", tokens(F.col(field)).alias("t"))
    counted = cut.select("id", F.size("t").alias("len"), *(_times("t", t).alias(f"tf{i}") for i, t in enumerate(terms)))
    spark = rows.sparkSession
    path = fresh_path(spark, "bm25")
    counted.write.parquet(path)
    counted = spark.read.schema(counted.schema).parquet(path)
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    if not stats.n or not stats.avg:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    score = reduce(lambda a, b: a + b, (term_weight(F.col(f"tf{i}"), F.col("len"), stats.n, stats.avg, stats[f"df{i}"]) for i in range(len(terms))))
    return counted.select("id", score.alias("score")).where("score > 0")


#: Folders that the terms of an index are dealt into.
SLICES = 64


def term_slice(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLICES)).cast("int")


def write_postings(rows: DataFrame, field: str, path: str) -> None:
    """Writes an index of a field: how often each row holds each term, in folders by the term's hash, and the rows' number and mean length."""
    words = rows.select("id", tokens(F.col(field)).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    found = words.groupBy("term", "id", "len").agg(F.count("*").cast("int").alias("tf")).withColumn("slice", term_slice(F.col("term")))
    found.repartition(SLICES, "slice").sortWithinPartitions("slice", "term").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/terms")
    rows.select(F.size(tokens(F.col(field))).alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg")).write.mode("overwrite").parquet(f"{path}/stats")


def bm25_of_postings(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id, score) from an index: only the folders of the query's terms are read, and of these the terms' own row groups."""
    terms = terms_of(query)
    postings = spark.read.parquet(f"{path}/terms")
    stats = spark.read.parquet(f"{path}/stats").first()
    slices = [r.s for r in spark.createDataFrame([(t,) for t in terms], "t string").select(term_slice(F.col("t")).alias("s")).collect()]  # a row for each term
    met = postings.where(F.col("slice").isin(slices) & F.col("term").isin(terms))
    known = {r.term: r.df for r in met.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term
    if not known:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    score = reduce(lambda rest, t: F.when(F.col("term") == t, term_weight(F.col("tf"), F.col("len"), stats.n, stats.avg, known[t])).otherwise(rest), sorted(known), F.lit(0.0))
    return met.groupBy("id").agg(F.sum(score).alias("score"))


def search(documents: DataFrame, query: str | None = None, sort: str | None = None, limit: int = 20, offset: int = 0, scores: DataFrame | None = None, **filters) -> DataFrame:
    """A page of matching documents with ``score`` and the ``total`` of all matches.

    scores: (id, score) of the fields for the query, from an index that is kept; without them the fields are scanned.

    The score is the best boosted field's; tags count when one equals the whole query. Unknown sort orders mean relevance.
    """
    rows = documents.where(matches(**filters))
    if query:
        if scores is None:
            scores = reduce(lambda a, b: a.unionByName(b), [bm25(documents, f, query).withColumn("score", F.col("score") * boost) for f, boost in FIELDS.items()])
        tagged = documents.where(F.array_contains("tags", query)).select("id", F.lit(1.0).alias("score"))
        rows = rows.join(scores.select("id", "score").unionByName(tagged).groupBy("id").agg(F.max("score").alias("score")), "id")
    else:
        rows = rows.withColumn("score", F.lit(1.0))
    order = {"price_asc": [F.asc("price")], "price_desc": [F.desc("price")], "rating_desc": [F.desc("rating_average")]}.get(sort or "", [F.desc("score")])
    total = rows.count()
    return rows.withColumn("total", F.lit(total).cast("bigint")).orderBy(*order, "id").offset(offset).limit(limit)
