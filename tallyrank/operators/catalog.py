"""Product lookups, request candidates and per-product facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyrank.contract import FIELD_WEIGHTS, HISTORY_LIMIT
from tallyrank.functions.numeric import ratio
from tallyrank.functions.vectors import norm
from tallyrank.operators.ordered import SLACK, rank_brackets
from tallyrank.session import materialize
from tallyrank.sources.tables import epoch_seconds

ANY = ""
HALF_LIFE_DAYS = 180.0
FULL_STOCK = 50
# Searches that share one copy of a term's list.
SEARCHES = 4_096


def product_page(
    products: DataFrame, skip: int, limit: int, text: str | None = None, category: str | None = None
) -> DataFrame:
    """One page of products in id order, after the optional filters.

    A text of several words finds products that have any of them, as a search does.
    """
    page = products
    if text and text.split():
        page = page.filter(F.arrays_overlap(name_terms(), F.array(*(F.lit(w) for w in text.lower().split()))))
    if category:
        page = page.filter(F.col("category") == category)
    return page.orderBy("product_id").offset(max(skip, 0)).limit(limit)


def name_terms(name: str = "name") -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.col(name)), r"\s+"), ""))


def recent_interactions(feed: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Latest ``limit`` interactions of every user.

    The rank limit is applied before the shuffle as well, so a very active user
    sends at most ``limit`` rows per input partition.
    """
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.asc("event_id"))
    return feed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= limit)


def products_by_ids(products: DataFrame, ids: DataFrame) -> DataFrame:
    """Products whose id occurs in ``ids``."""
    return products.join(ids, "product_id", "left_semi")


def embedding_lookup(
    asked: DataFrame, text: DataFrame, image: DataFrame | None = None, most: int = 100
) -> DataFrame:
    """Vectors for a comma-separated id list, at most ``most`` ids each.

    Blank entries are dropped and unknown ids keep a null vector.
    """
    ids = F.filter(
        F.transform(F.split("ids", ","), lambda s: F.trim(s)), lambda s: s != F.lit("")
    )
    rows = asked.select(
        "lookup_id", F.posexplode(F.slice(ids, 1, most)).alias("position", "id_text")
    ).withColumn("product_id", F.expr("try_cast(id_text AS BIGINT)"))
    out = rows.join(text.withColumnRenamed("vec", "text_vec"), "product_id", "left")
    if image is not None:
        out = out.join(image.withColumnRenamed("vec", "image_vec"), "product_id", "left")
    return out


def normalize_product(products: DataFrame) -> DataFrame:
    """Ids and instants as strings."""
    return products.withColumns(
        {
            "product_id": F.col("product_id").cast("string"),
            "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
        }
    )


def product_factors(products: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Popularity, recency, price and stock scores, one row per product.

    The maxima are one scalar subquery; price bounds are per category and come
    from a map-side aggregate, not from a window over a category's products.
    ``catalogue`` gives category and price without the cost of the sales facts.
    """
    totals = products.agg(
        F.struct(
            F.max("reviews_count").alias("reviews"),
            F.max(epoch_seconds("created_at")).alias("newest"),
        ).alias("t")
    )
    # Products without a category are priced among themselves.
    bounds = (products if catalogue is None else catalogue).groupBy(F.col("category").alias("_category")).agg(
        F.min("price").alias("low"), F.max("price").alias("high")
    )
    most = totals.scalar()["reviews"].cast("double")
    age_days = (totals.scalar()["newest"] - epoch_seconds("created_at")).cast("double") / F.lit(86400.0)
    popularity = F.lit(0.6) * F.col("rating") / F.lit(5.0) + F.lit(0.4) * ratio(
        F.log(F.lit(1.0) + F.col("reviews_count")), F.log(F.lit(1.0) + most)
    )
    price = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(
        F.lit(1.0) - ratio(F.col("price") - F.col("low"), F.col("high") - F.col("low"))
    )
    return products.join(bounds, F.col("category").eqNullSafe(F.col("_category")), "left").select(
        *products.columns,
        popularity.alias("popularity_score"),
        F.coalesce(F.pow(F.lit(0.5), age_days / F.lit(HALF_LIFE_DAYS)), F.lit(0.0)).alias(
            "recency_score"
        ),
        price.alias("price_score"),
        F.least(F.col("stock") / F.lit(float(FULL_STOCK)), F.lit(1.0)).alias("stock_score"),
    )


def normalize_query(query: str = "query") -> Column:
    return F.lower(F.col(query))


def query_terms(query: str = "query") -> Column:
    """Distinct lower-case words of a query; the wildcard for an absent one."""
    terms = F.array_distinct(F.array_remove(F.split(F.lower(F.col(query)), r"\s+"), ""))
    none = F.array(F.lit(ANY))
    return F.when(F.col(query).isNull() | (F.size(terms) == 0), none).otherwise(terms)


def candidates(requests: DataFrame, products: DataFrame, slack: int = SLACK) -> DataFrame:
    """(request_id, product_id, position) of the candidate page of every request.

    A page skips ``(page - 1) * page_size`` matching products in id order and
    takes ``2 * page_size``.  Work per request is its page, never its matches:

    1. every search (query and category) is as deep as the deepest of its own
       requests, and every term of it as the deepest search that has the term;
    2. products of a (term, category) are counted by id range until the ranges that
       hold its first products are known to within ``slack`` rows; only those
       products are shuffled and ranked;
    3. lists of the terms of a search are merged and cut at its depth, a term of
       many searches in several parts;
    4. requests look their positions up by equality.
    """
    asked = requests.select(
        "request_id",
        F.coalesce(normalize_query(), F.lit(ANY)).alias("q"),
        F.coalesce("category", F.lit(ANY)).alias("cat"),
        query_terms().alias("terms"),
        F.greatest((F.col("page") - 1) * F.col("page_size"), F.lit(0)).alias("skip"),
        (2 * F.col("page_size")).alias("take"),
    )
    deep = asked.groupBy("q", "cat").agg(F.max(F.col("skip") + F.col("take")).alias("depth"), F.first("terms").alias("terms"))
    searches = materialize(deep.filter("depth > 0").select("q", "cat", "depth", F.explode("terms").alias("term")), "searches")
    parts = F.ceil(F.count("*") / F.lit(SEARCHES)).cast("int")
    terms = searches.groupBy("term", "cat").agg(F.max("depth").cast("bigint").alias("need"), parts.alias("parts"))
    listed = products.select(
        "product_id",
        F.explode(F.array("category", F.lit(ANY))).alias("cat"),
        F.array_union(name_terms(), F.array(F.lit(ANY))).alias("terms"),
    ).select("product_id", "cat", F.explode("terms").alias("term"))
    wanted = listed.join(terms.select("term", "cat"), ["term", "cat"], "left_semi").withColumn("one", F.lit(1))
    keys = ["term", "cat"]
    cuts = rank_brackets(wanted, keys, keys, "product_id", "one", terms.select(*keys, "need"), slack)
    heads = wanted.join(cuts.select(*keys, F.col("high").alias("last")), keys).filter(F.col("product_id") <= F.col("last"))
    by_term = W.partitionBy(*keys).orderBy("product_id")
    lists = heads.select(*keys, "product_id").withColumn("rn", F.row_number().over(by_term))
    lists = lists.join(terms, keys).filter(F.col("rn") <= F.col("need"))
    lists = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = searches.join(terms.select(*keys, "parts"), keys)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).drop("parts")
    merged = (
        lists.join(dealt, [*keys, "part"]).filter(F.col("rn") <= F.col("depth"))
        .select("q", "cat", "depth", "product_id").distinct()
    )
    by_query = W.partitionBy("q", "cat").orderBy("product_id")
    pages = merged.withColumn("slot", F.row_number().over(by_query)).filter(F.col("slot") <= F.col("depth")).drop("depth")
    slots = asked.filter("take > 0").select(
        "request_id",
        "q",
        "cat",
        "skip",
        F.explode(F.sequence(F.col("skip") + 1, F.col("skip") + F.col("take"))).alias("slot"),
    )
    return slots.join(pages, ["q", "cat", "slot"]).select(
        "request_id", "product_id", (F.col("slot") - F.col("skip")).cast("int").alias("position")
    )


def field_boost(terms: Column, name="name", category="category", brand="brand") -> Column:
    """Weight of every product field that contains a query term."""
    words = F.filter(terms, lambda t: t != F.lit(ANY))

    def contained(field: str) -> Column:
        text = F.lower(F.col(field))
        return F.exists(words, lambda t: F.contains(text, t)).cast("double")

    tags = F.arrays_overlap(words, name_terms(name)).cast("double")
    w = FIELD_WEIGHTS
    return (
        F.lit(w["name"]) * contained(name)
        + F.lit(w["category"]) * contained(category)
        + F.lit(w["brand"]) * contained(brand)
        + F.lit(w["tags"]) * tags
    )


def with_norms(vectors: DataFrame) -> DataFrame:
    """Vector length computed once per vector instead of once per pair."""
    return vectors.withColumn("len", norm(F.col("vec")))
