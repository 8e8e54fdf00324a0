"""Product ranking, popularity lists, ranking quality and request statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrank.contract import (
    BOOST_WEIGHTS, DEFAULT_COLLABORATIVE, DIVERSITY_ALPHA, FACTOR_WEIGHTS, FIELD_WEIGHTS,
    SCORE_WEIGHTS,
)
from tallyrank.functions.numeric import rounded
from tallyrank.operators import (
    catalog, factors, popularity, preferences as pref, ranking, ranking_metrics, traffic,
)
from tallyrank.plans import recommend as plan
from tallyrank.registry.base import query
from tallyrank.registry.sql import R, VIEWS, div, with_views
from tallyrank.session import scratch_path
from tallyrank.sources import tables
from tallyrank.sources.store import RECOMMENDATION_LOG, Store

_HALF = "CAST(0.5 AS DOUBLE)"


def d(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


VIEWS.update({
    "factors": (["products"], f"""
      SELECT *, {d(0.6)} * rating / 5 + {d(0.4)} * {div("ln(1 + reviews_count)",
          "ln(1 + (SELECT max(reviews_count) FROM products))")} AS popularity_score,
        coalesce(pow({_HALF}, ((SELECT epoch(max(created_at)) FROM products) - epoch(created_at))
          / 86400 / 180), 0) AS recency_score,
        CASE WHEN high = low THEN CAST(1 AS DOUBLE) ELSE 1 - {div("price - low", "high - low")} END
          AS price_score,
        least(stock / CAST(50 AS DOUBLE), 1) AS stock_score
      FROM (SELECT *, min(price) OVER (PARTITION BY category) AS low,
              max(price) OVER (PARTITION BY category) AS high FROM products)"""),
    "affinity": (["inter"], """
      SELECT user_id, product_id, sum(w) AS affinity, count(*) AS events
      FROM inter GROUP BY user_id, product_id"""),
    "known": (["affinity"], """
      SELECT user_id, product_id, affinity / max(affinity) OVER (PARTITION BY user_id) AS score
      FROM affinity"""),
    "cand": (["reqs", "products"], """
      SELECT request_id, product_id, CAST(pos - skip AS INTEGER) AS position FROM (
        SELECT r.request_id, p.product_id, (page - 1) * page_size AS skip, 2 * page_size AS take,
          row_number() OVER (PARTITION BY r.request_id ORDER BY p.product_id) AS pos
        FROM reqs r JOIN products p
          ON (r.query IS NULL
              OR list_has_any(string_split(lower(p.name), ' '), string_split(lower(r.query), ' ')))
          AND (r.category IS NULL OR r.category = p.category))
      WHERE pos > skip AND pos <= skip + take"""),
    "recent": (["inter"], """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)
        AS rn FROM inter) WHERE rn <= 100"""),
    "haff": (["recent"], """
      SELECT user_id, product_id, sum(w) AS affinity FROM recent GROUP BY user_id, product_id"""),
    "hown": (["haff"], """
      SELECT user_id, product_id, affinity / max(affinity) OVER (PARTITION BY user_id) AS share
      FROM haff"""),
    **{
        f"h{f}": (["haff", "products"], f"""
          SELECT user_id, {f}, sum(affinity) / sum(sum(affinity)) OVER (PARTITION BY user_id) AS share
          FROM haff JOIN products USING (product_id) GROUP BY user_id, {f}""")
        for f in ("category", "brand")
    },
    "comp": (["cand", "reqs", "factors", "known", "hown", "hcategory", "hbrand"], f"""
      SELECT c.request_id, r.user_id, c.product_id, c.position, r.page_size, p.category, p.brand,
        p.price, p.discount_price, p.stock, popularity_score, recency_score, price_score, stock_score,
        CASE WHEN r.query IS NULL OR tv.embedding IS NULL THEN CAST(0 AS DOUBLE)
          ELSE list_cosine_similarity(qv.embedding::DOUBLE[], tv.embedding::DOUBLE[]) END AS "text",
        CASE WHEN qi.embedding IS NULL OR iv.embedding IS NULL THEN CAST(0 AS DOUBLE)
          ELSE list_cosine_similarity(qi.embedding::DOUBLE[],
            list_reverse(iv.embedding::DOUBLE[])) END AS image,
        CASE WHEN r.query IS NULL THEN CAST(0 AS DOUBLE) ELSE
          {" + ".join(
              d(FIELD_WEIGHTS[f]) + f" * CASE WHEN len(list_filter(string_split(lower(r.query), ' '), "
              f"lambda t: contains(lower(p.{f}), t))) > 0 THEN 1 ELSE 0 END"
              for f in ("name", "category", "brand"))}
          + {d(FIELD_WEIGHTS["tags"])} * CASE WHEN list_has_any(string_split(lower(p.name), ' '),
              string_split(lower(r.query), ' ')) THEN 1 ELSE 0 END END AS field,
        least(1, {d(BOOST_WEIGHTS["affinity"])} * coalesce(o.share, 0)
          + {d(BOOST_WEIGHTS["category"])} * coalesce(hc.share, 0)
          + {d(BOOST_WEIGHTS["brand"])} * coalesce(hb.share, 0)) AS interaction,
        coalesce(k.score, {d(DEFAULT_COLLABORATIVE)}) AS hybrid
      FROM cand c JOIN reqs r USING (request_id) JOIN factors p ON p.product_id = c.product_id
        LEFT JOIN embeddings qv ON qv.vec_id = r.query_vec_id
        LEFT JOIN embeddings tv ON tv.vec_id = c.product_id
        LEFT JOIN embeddings qi ON qi.vec_id = r.image_vec_id
        LEFT JOIN embeddings iv ON iv.vec_id * 2 = c.product_id
        LEFT JOIN known k ON k.user_id = r.user_id AND k.product_id = c.product_id
        LEFT JOIN hown o ON o.user_id = r.user_id AND o.product_id = c.product_id
        LEFT JOIN hcategory hc ON hc.user_id = r.user_id AND hc.category = p.category
        LEFT JOIN hbrand hb ON hb.user_id = r.user_id AND hb.brand = p.brand"""),
    "chain": (["comp"], f"""
      SELECT *, CASE WHEN n > 5 THEN multi * (1 - {d(DIVERSITY_ALPHA)} * (r - 1) / r)
          ELSE multi END AS diverse
      FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n,
              CAST(row_number() OVER (PARTITION BY request_id, category
                ORDER BY multi DESC, product_id) AS DOUBLE) AS r
            FROM (SELECT *, round({d(FACTOR_WEIGHTS["base"])} * combined
                + {d(FACTOR_WEIGHTS["popularity"])} * popularity_score
                + {d(FACTOR_WEIGHTS["recency"])} * recency_score
                + {d(FACTOR_WEIGHTS["price"])} * price_score, 9) AS multi
              FROM (SELECT *, round({" + ".join(d(w) + f' * "{n}"' for n, w in SCORE_WEIGHTS.items())},
                9) AS combined FROM comp)))"""),
    "ranked": (["chain"], """
      SELECT *, CASE WHEN hi > lo THEN (diverse - lo) / (hi - lo) ELSE CAST(1 AS DOUBLE) END AS score
      FROM (SELECT *, min(diverse) OVER (PARTITION BY request_id) AS lo,
              max(diverse) OVER (PARTITION BY request_id) AS hi,
              CAST(row_number() OVER (PARTITION BY request_id ORDER BY diverse DESC, product_id)
                AS INTEGER) AS "rank" FROM chain) WHERE "rank" <= page_size"""),
})


def _inputs(spark, root):
    return dict(
        requests=tables.requests(spark, root),
        products=tables.products(spark, root),
        feed=tables.valid_interactions(spark, root),
        text=tables.text_vectors(spark, root),
        image=tables.image_vectors(spark, root),
        catalogue=tables.catalogue(spark, root),
    )


def _components(spark, root):
    return plan.component_scores(**_inputs(spark, root))


# Reads.


@query("product_page", with_views("products", """
  SELECT product_id, name, category FROM products
  WHERE list_contains(string_split(lower(name), ' '), 'red') AND category = 'ECONOMY'
  ORDER BY product_id OFFSET 5 LIMIT 20"""))
def product_page(spark, root):
    page = catalog.product_page(tables.catalogue(spark, root), 5, 20, "red", "ECONOMY")
    return page.select("product_id", "name", "category")


@query("user_recent_interactions", with_views("recent", """
  SELECT user_id, event_id, product_id, kind, CAST(rn AS INTEGER) AS rn FROM recent"""))
def user_recent_interactions(spark, root):
    recent = catalog.recent_interactions(tables.valid_interactions(spark, root))
    return recent.select("user_id", "event_id", "product_id", "kind", "rn")


@query("products_by_ids", with_views("products", """
  SELECT product_id, name, brand, price FROM products
  WHERE product_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)"""))
def products_by_ids(spark, root):
    """Products of the lines with the largest quantity."""
    ids = tables.table(spark, root, "lineitem").filter("l_quantity = 50").select(
        F.col("l_partkey").alias("product_id")
    )
    found = catalog.products_by_ids(tables.catalogue(spark, root), ids)
    return found.select("product_id", "name", "brand", "price")


@query("embedding_lookup", f"""
  SELECT lookup_id, CAST(position AS INTEGER) AS position, product_id, text_first, image_first FROM (
    SELECT c_custkey AS lookup_id, 0 AS position, c_custkey AS product_id FROM customer
    UNION ALL SELECT c_custkey, 1, c_custkey * 2 FROM customer
    UNION ALL SELECT c_custkey, 2, c_custkey + 300 FROM customer)
  LEFT JOIN (SELECT vec_id AS product_id, {R("embedding[1]::DOUBLE")} AS text_first FROM embeddings)
    USING (product_id)
  LEFT JOIN (SELECT vec_id * 2 AS product_id, {R("embedding[64]::DOUBLE")} AS image_first
    FROM embeddings) USING (product_id)""")
def embedding_lookup(spark, root):
    """Three ids per customer, written with blanks and empty entries."""
    key = F.col("c_custkey")
    asked = tables.table(spark, root, "customer").select(
        key.alias("lookup_id"),
        F.concat_ws(",", F.concat(F.lit(" "), key), F.lit(" "), (key * 2), F.lit(""),
                    F.concat((key + 300).cast("string"), F.lit("  "))).alias("ids"),
    )
    out = catalog.embedding_lookup(
        asked, tables.text_vectors(spark, root), tables.image_vectors(spark, root)
    )
    return out.select(
        "lookup_id", "position", "product_id",
        rounded(F.get("text_vec", F.lit(0))).alias("text_first"),
        rounded(F.get("image_vec", F.lit(0))).alias("image_first"),
    )


@query("normalize_product", with_views("products", """
  SELECT CAST(product_id AS VARCHAR) AS product_id, name,
    strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM products"""))
def normalize_product(spark, root):
    return catalog.normalize_product(tables.products(spark, root)).select(
        "product_id", "name", "created_at"
    )


# Component scores.


@query("candidates", with_views("cand", "SELECT * FROM cand"))
def candidates(spark, root):
    return catalog.candidates(tables.requests(spark, root), tables.catalogue(spark, root))


@query("normalize_query", with_views("reqs", "SELECT request_id, lower(query) AS query FROM reqs"))
def normalize_query(spark, root):
    return tables.requests(spark, root).select(
        "request_id", catalog.normalize_query().alias("query")
    )


def _one(component: str):
    def run(spark, root):
        rows = _components(spark, root)
        return rows.select("request_id", "product_id", rounded(component).alias(component))

    return run


for _name, _component in {
    "text_similarity": "text",
    "image_similarity": "image",
    "field_boost": "field",
    "collaborative_score": "hybrid",
}.items():
    query(_name, with_views("comp", f"""
      SELECT request_id, product_id, {R(chr(34) + _component + chr(34))} AS "{_component}"
      FROM comp"""))(_one(_component))


@query("user_product_affinity", with_views("affinity", "SELECT * FROM affinity"))
def user_product_affinity(spark, root):
    return pref.user_product_affinity(tables.valid_interactions(spark, root))


def _prefs_sql(field: str) -> str:
    return with_views("affinity products", f"""
      SELECT user_id, {field},
        {R("sum(affinity) / sum(sum(affinity)) OVER (PARTITION BY user_id)")} AS preference
      FROM affinity JOIN products USING (product_id) GROUP BY user_id, {field}""")


@query("user_category_prefs", _prefs_sql("category"))
def user_category_prefs(spark, root):
    affinity = pref.user_product_affinity(tables.valid_interactions(spark, root))
    out = pref.category_preferences(affinity, tables.catalogue(spark, root))
    return out.withColumn("preference", rounded("preference"))


@query("user_brand_prefs", _prefs_sql("brand"))
def user_brand_prefs(spark, root):
    affinity = pref.user_product_affinity(tables.valid_interactions(spark, root))
    out = pref.brand_preferences(affinity, tables.catalogue(spark, root))
    return out.withColumn("preference", rounded("preference"))


@query("user_price_pref", with_views("affinity products", f"""
  SELECT user_id, count(*) AS products, {R("sum(affinity * price) / sum(affinity)", 4)} AS mean_price,
    {R("sqrt(greatest(sum(affinity * price * price) / sum(affinity) "
       "- pow(sum(affinity * price) / sum(affinity), 2), 0))", 4)} AS price_deviation
  FROM affinity JOIN products USING (product_id) GROUP BY user_id"""))
def user_price_pref(spark, root):
    affinity = pref.user_product_affinity(tables.valid_interactions(spark, root))
    out = pref.price_preference(affinity, tables.catalogue(spark, root))
    return out.withColumns({c: rounded(c, 4) for c in ("mean_price", "price_deviation")})


@query("interaction_boost", with_views("cand reqs products hown hcategory hbrand", f"""
  SELECT request_id, c.product_id, {R(f'''least(1, {d(BOOST_WEIGHTS["affinity"])} * coalesce(o.share, 0)
      + {d(BOOST_WEIGHTS["category"])} * coalesce(hc.share, 0)
      + {d(BOOST_WEIGHTS["brand"])} * coalesce(hb.share, 0))''')} AS interaction
  FROM cand c JOIN reqs r USING (request_id) JOIN products p ON p.product_id = c.product_id
    LEFT JOIN hown o ON o.user_id = r.user_id AND o.product_id = c.product_id
    LEFT JOIN hcategory hc ON hc.user_id = r.user_id AND hc.category = p.category
    LEFT JOIN hbrand hb ON hb.user_id = r.user_id AND hb.brand = p.brand"""))
def interaction_boost(spark, root):
    products = tables.catalogue(spark, root)
    reqs = tables.requests(spark, root)
    pairs = (
        catalog.candidates(reqs, products)
        .join(reqs.select("request_id", "user_id"), "request_id")
        .join(products.select("product_id", "category", "brand"), "product_id")
    )
    history = catalog.recent_interactions(tables.valid_interactions(spark, root))
    out = pref.interaction_boost(pairs, history, products)
    return out.select("request_id", "product_id", rounded("interaction").alias("interaction"))


@query("unseen_candidates", with_views("cand reqs inter", """
  SELECT request_id, product_id FROM cand c JOIN reqs r USING (request_id)
  WHERE NOT EXISTS (SELECT 1 FROM inter i WHERE i.user_id = r.user_id
    AND i.product_id = c.product_id)"""))
def unseen_candidates(spark, root):
    reqs = tables.requests(spark, root)
    pairs = catalog.candidates(reqs, tables.catalogue(spark, root)).join(
        reqs.select("request_id", "user_id"), "request_id"
    )
    out = pref.unseen(pairs, tables.valid_interactions(spark, root))
    return out.select("request_id", "product_id")


_FACTORS = ["popularity_score", "recency_score", "price_score", "stock_score"]


@query("product_factor_scores", with_views("factors", f"""
  SELECT product_id, {", ".join(f"{R(c)} AS {c}" for c in _FACTORS)} FROM factors"""))
def product_factor_scores(spark, root):
    out = catalog.product_factors(tables.products(spark, root), tables.catalogue(spark, root))
    return out.select("product_id", *[rounded(c).alias(c) for c in _FACTORS])


# The chain.


def _chain(column: str):
    def run(spark, root):
        rows = plan.score_chain(_components(spark, root))
        return rows.select("request_id", "product_id", column)

    return run


for _name, _column in {
    "combined_score": "combined",
    "multi_factor_score": "multi",
    "diversity_penalty": "diverse",
}.items():
    query(_name, with_views("chain", f"""
      SELECT request_id, product_id, {_column} FROM chain"""))(_chain(_column))


@query("top_k_recommendations", with_views("ranked", f"""
  SELECT request_id, "rank", product_id, diverse AS score FROM ranked"""))
def top_k_recommendations(spark, root):
    scored = plan.score_chain(_components(spark, root))
    top = ranking.top_k(scored, "diverse", "page_size")
    return top.select(
        "request_id", "rank", "product_id", F.col("diverse").alias("score")
    )


_RANKED_SQL = with_views("ranked", f"""
  SELECT request_id, "rank", product_id, {R("score")} AS score FROM ranked""")


def _ranked(spark, root):
    return plan.recommend(_components(spark, root))


@query("normalized_recommendations", _RANKED_SQL)
def normalized_recommendations(spark, root):
    out = _ranked(spark, root)
    return out.select("request_id", "rank", "product_id", rounded("score").alias("score"))


_EXPLAIN = """
  CASE WHEN reasons = '' THEN 'Recommended for you' ELSE 'Recommended: ' || reasons END AS explanation
  FROM (SELECT *, concat_ws(', ',
    CASE WHEN popularity_score > 0.7 THEN 'highly popular'
         WHEN popularity_score > 0.5 THEN 'well-rated' END,
    CASE WHEN recency_score > 0.8 THEN 'new arrival' END,
    CASE WHEN price_score > 0.5 AND coalesce(discount_price, 0) <> 0
           THEN CAST(CAST(round_even((1 - discount_price / price) * 100, 0) AS INTEGER) AS VARCHAR)
             || '% off'
         WHEN price_score > 0.5 THEN 'great value' END,
    CASE WHEN coalesce(stock, 0) < 10 THEN 'low stock' END,
    CASE WHEN field > 0.3 THEN 'matches your search' END,
    CASE WHEN interaction > 0.3 THEN 'based on your preferences' END,
    CASE WHEN "text" > 0.6 THEN 'similar to your query' END,
    CASE WHEN image > 0.6 THEN 'visually similar' END) AS reasons FROM {source})"""
_PARTS = list(SCORE_WEIGHTS)


@query("score_breakdown", with_views("ranked", f"""
  SELECT request_id, product_id, {", ".join(f'{R(chr(34) + c + chr(34))} AS "{c}"' for c in _PARTS)},
    {R("score")} AS final, {", ".join(f"{d(w)} AS weight_{n}" for n, w in SCORE_WEIGHTS.items())},
    {_EXPLAIN.format(source="ranked")}"""))
def score_breakdown(spark, root):
    rows = _ranked(spark, root).withColumn("b", ranking.breakdown("score"))
    return rows.select(
        "request_id", "product_id",
        *[rounded(F.col(f"b.{c}")).alias(c) for c in _PARTS],
        rounded(F.col("b.final")).alias("final"),
        *[F.col("b.weights")[n].alias(f"weight_{n}") for n in SCORE_WEIGHTS],
        F.col("b.explanation").alias("explanation"),
    )


@query("explanation", with_views("comp", f"""
  SELECT request_id, product_id, {_EXPLAIN.format(source="comp")}"""))
def explanation(spark, root):
    return _components(spark, root).select(
        "request_id", "product_id", ranking.explanation().alias("explanation")
    )


@query("batch_recommendations", with_views("ranked reqs", f"""
  SELECT r.request_id, "rank", product_id, {R("score")} AS score
  FROM reqs r LEFT JOIN ranked k ON k.request_id = r.request_id"""))
def batch_recommendations(spark, root):
    out = plan.with_empty(tables.requests(spark, root), _ranked(spark, root))
    return out.select("request_id", "rank", "product_id", rounded("score").alias("score"))


@query("recommend", with_views("ranked products", f"""
  SELECT request_id, user_id, "rank", k.product_id, name, p.price, {R("score")} AS score
  FROM ranked k JOIN products p ON p.product_id = k.product_id"""))
def recommend(spark, root):
    names = tables.table(spark, root, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name")
    )
    return _ranked(spark, root).join(names, "product_id").select(
        "request_id", "user_id", "rank", "product_id", "name", "price",
        rounded("score").alias("score"),
    )


@query("recommend_learned")
def recommend_learned(spark, root):
    """Recommendations whose collaborative scores come from learned factors."""
    inputs = _inputs(spark, root)
    fitted = factors.fit_factors(pref.user_product_affinity(inputs["feed"]))
    known = plan.learned_scores(inputs["requests"], inputs["catalogue"], fitted)
    ranked = plan.recommend(plan.component_scores(**inputs, known=known))
    return ranked.select("request_id", "user_id", "rank", "product_id", rounded("hybrid").alias("hybrid"), rounded("score").alias("score"))


@query("recommendation_log", with_views("ranked reqs cand", """
  SELECT request_id, min(r.user_id) AS user_id, min(r.query) AS query,
    string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY "rank") AS recommended_products,
    string_agg(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY "rank")
      AS score_millionths,
    CAST(any_value(found) AS INTEGER) AS total_products, min(r.page) AS page, count(r.image_vec_id) > 0 AS has_image
  FROM ranked JOIN reqs r USING (request_id)
    JOIN (SELECT request_id, count(*) AS found FROM cand GROUP BY request_id) USING (request_id)
  GROUP BY request_id"""))
def recommendation_log(spark, root):
    """Log rows appended to a store, the run tried twice, and read back; arrays written as text."""
    log = Store(spark, scratch_path(spark, "recommendation-log"), RECOMMENDATION_LOG)
    rows = ranking.recommendation_log(_ranked(spark, root), tables.requests(spark, root), "score")
    log.append(rows, "first")
    log.append(rows, "first")
    whole = F.transform("scores", lambda s: F.round(s * 1000000).cast("bigint").cast("string"))
    fact = lambda name, kind: F.col("metadata")[name].cast(kind).alias(name)
    return log.read().select(
        "request_id", "user_id", "query",
        F.concat_ws(",", F.col("recommended_products").cast("array<string>")).alias(
            "recommended_products"
        ),
        F.concat_ws(",", whole).alias("score_millionths"),
        fact("total_products", "int"), fact("page", "int"), fact("has_image", "boolean"),
    )


# Popularity lists.


@query("trending", with_views("inter products", """
  SELECT product_id, name, sum(w) AS weight, count(*) AS events
  FROM inter JOIN products USING (product_id)
  WHERE ts > (SELECT max(ts) FROM inter) - INTERVAL 24 HOURS
  GROUP BY product_id, name ORDER BY weight DESC, product_id LIMIT 20"""))
def trending(spark, root):
    out = popularity.trending(
        tables.valid_interactions(spark, root), tables.catalogue(spark, root)
    )
    return out.select("product_id", "name", "weight", "events")


@query("popular", with_views("inter factors", """
  SELECT product_id, name, round(sum(w) * max(popularity_score), 6) AS score, count(*) AS events
  FROM inter JOIN factors USING (product_id)
  WHERE ts > (SELECT max(ts) FROM inter) - INTERVAL 720 HOURS
  GROUP BY product_id, name ORDER BY score DESC, product_id LIMIT 20"""))
def popular(spark, root):
    factors = catalog.product_factors(tables.products(spark, root), tables.catalogue(spark, root))
    out = popularity.popular(tables.valid_interactions(spark, root), factors)
    return out.select("product_id", "name", "score", "events")


@query("trending_with_fallback", with_views("inter products", """
  , recent_lines AS (SELECT product_id, sum(w) AS score FROM inter JOIN products USING (product_id)
      WHERE ts > (SELECT max(ts) FROM inter) - INTERVAL 24 HOURS AND kind = 'wishlist'
      GROUP BY product_id ORDER BY score DESC, product_id LIMIT 20),
  month AS (SELECT product_id, sum(w) AS score FROM inter JOIN products USING (product_id)
      GROUP BY product_id ORDER BY score DESC, product_id LIMIT 20),
  fixed AS (SELECT product_id, CAST(reviews_count AS DOUBLE) AS score FROM products
      ORDER BY reviews_count DESC, product_id LIMIT 20),
  u AS (SELECT 0 AS priority, * FROM recent_lines UNION ALL SELECT 1, * FROM month
      UNION ALL SELECT 2, * FROM fixed)
  SELECT priority, product_id, score FROM u WHERE priority = (SELECT min(priority) FROM u)"""))
def trending_with_fallback(spark, root):
    """A kind nobody uses leaves the first list empty, so the second one answers."""
    feed = tables.valid_interactions(spark, root)
    products = tables.products(spark, root)
    first = popularity.trending(feed.filter("kind = 'wishlist'"), products)
    second = popularity.trending(feed, products, hours=24 * 31)
    third = products.orderBy(F.desc("reviews_count"), "product_id").limit(20)
    lists = [first.select("product_id", F.col("weight").alias("score")),
             second.select("product_id", F.col("weight").alias("score")),
             third.select("product_id", F.col("reviews_count").cast("double").alias("score"))]
    return popularity.first_available(lists)


# Ranking quality: lists from the first 20 days against the rest.

K = 10
CUT = "2024-01-21 00:00:00"
_QUALITY_SQL = with_views("inter", f"""
  , early AS (SELECT user_id, product_id, sum(w) AS s FROM inter WHERE ts < TIMESTAMP '{CUT}'
      GROUP BY user_id, product_id),
  lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY s DESC, product_id) AS rk FROM early) WHERE rk <= {K}),
  truth AS (SELECT DISTINCT user_id, product_id FROM inter WHERE ts >= TIMESTAMP '{CUT}'),
  rel AS (SELECT user_id, count(*) AS n FROM truth GROUP BY user_id),
  per AS (SELECT l.user_id, count(t.product_id) AS hits,
      coalesce(sum(CASE WHEN t.product_id IS NOT NULL THEN 1 / log2(rk + 1) END), 0) AS dcg
    FROM lists l LEFT JOIN truth t ON t.user_id = l.user_id AND t.product_id = l.product_id
    GROUP BY l.user_id),
  q AS (SELECT per.user_id, hits, coalesce(n, 0) AS relevant, hits / CAST({K} AS DOUBLE) AS precision_at_k,
      {div("hits", "coalesce(n, 0)")} AS recall_at_k,
      coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K} + 1) r(i) WHERE i <= n), 0)
        AS ndcg_at_k
    FROM per LEFT JOIN rel ON rel.user_id = per.user_id)
  """)


def _quality(spark, root):
    feed = tables.valid_interactions(spark, root)
    early = pref.user_product_affinity(feed.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz")))
    lists = ranking.top_k(early, "affinity", K, request="user_id")
    late = feed.filter(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))
    return ranking_metrics.ranking_quality(lists, late, K)


def _quality_query(metric: str):
    def run(spark, root):
        return _quality(spark, root).select(
            "user_id", "hits", "relevant", rounded(metric).alias(metric)
        )

    return run


for _metric in ("precision_at_k", "recall_at_k", "ndcg_at_k"):
    query(_metric, _QUALITY_SQL + f"SELECT user_id, hits, relevant, {R(_metric)} AS {_metric} FROM q")(
        _quality_query(_metric)
    )


# Request statistics.


@query("runtime_stats", with_views("reqlog", f"""
  SELECT count(*) AS predictions, {R("coalesce(avg(duration_ms), 0)", 4)} AS mean_ms FROM reqlog"""))
def runtime_stats(spark, root):
    out = traffic.runtime_stats(tables.request_log(spark, root))
    return out.withColumn("mean_ms", rounded("mean_ms", 4))


@query("request_stats", with_views("reqlog", f"""
  SELECT endpoint, count(*) AS requests, count(*) FILTER (status < 400) AS succeeded,
    {R("avg(duration_ms)", 4)} AS mean_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
    {R(div("count(*) FILTER (status < 400)", "count(*)"))} AS success_rate
  FROM reqlog GROUP BY endpoint"""))
def request_stats(spark, root):
    out = traffic.request_stats(tables.request_log(spark, root))
    return out.withColumns({"mean_ms": rounded("mean_ms", 4), "success_rate": rounded("success_rate")})


@query("latency_percentiles", with_views("reqlog", f"""
  SELECT endpoint, count(*) AS requests, {R("avg(duration_ms)", 4)} AS mean_ms,
    min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
    max(CASE WHEN i = floor(n * {d(0.5)}) THEN duration_ms END) AS p50_ms,
    max(CASE WHEN i = floor(n * {d(0.95)}) THEN duration_ms END) AS p95_ms,
    max(CASE WHEN i = floor(n * {d(0.99)}) THEN duration_ms END) AS p99_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY duration_ms) - 1 AS i,
    count(*) OVER (PARTITION BY endpoint) AS n FROM reqlog) GROUP BY endpoint"""))
def latency_percentiles(spark, root):
    out = traffic.latency_percentiles(tables.request_log(spark, root))
    return out.withColumn("mean_ms", rounded("mean_ms", 4))


@query("latency_rating", with_views("reqlog", """
  SELECT event_id, CASE WHEN duration_ms < 50 THEN 'excellent' WHEN duration_ms < 100 THEN 'good'
      ELSE 'needs improvement' END AS call_rating,
    CASE WHEN m < 20 THEN 'excellent' WHEN m < 50 THEN 'good' WHEN m < 100 THEN 'acceptable'
      ELSE 'needs improvement' END AS endpoint_rating
  FROM reqlog JOIN (SELECT endpoint, avg(duration_ms) AS m FROM reqlog GROUP BY endpoint)
    USING (endpoint)"""))
def latency_rating(spark, root):
    log = tables.request_log(spark, root)
    means = traffic.request_stats(log).select("endpoint", traffic.mean_rating("mean_ms").alias("e"))
    return log.join(means, "endpoint").select(
        "event_id",
        traffic.call_rating("duration_ms").alias("call_rating"),
        F.col("e").alias("endpoint_rating"),
    )


@query("rate_limit_offenders", with_views("reqlog", """
  SELECT user_id, CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS window_start, count(*) AS requests
  FROM reqlog GROUP BY user_id, date_trunc('minute', ts) HAVING count(*) > 1"""))
def rate_limit_offenders(spark, root):
    out = traffic.rate_limit_offenders(tables.request_log(spark, root), limit=1)
    return out.withColumn("window_start", tables.epoch_seconds("window_start"))
