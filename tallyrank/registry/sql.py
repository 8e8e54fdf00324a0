"""SQL forms of the source views, for the side-by-side check."""

from __future__ import annotations

from tallyrank.contract import INTERACTION_WEIGHTS, LINEAR_SCORERS, SEED


def R(expr: str, digits: int = 6) -> str:
    """Rounded value with negative zero folded into zero."""
    return f"(round({expr}, {digits}) + CAST(0 AS DOUBLE))"


def div(top: str, bottom: str) -> str:
    return (
        f"(CASE WHEN ({bottom}) = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) END)"
    )


def hash32(seed, *cols: str) -> str:
    text = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT)"


def _linear(name: str) -> str:
    b, *w = LINEAR_SCORERS[name]
    z = f"CAST({b!r} AS DOUBLE)"
    for x, c in zip(w, ["v1", "v2", "v3", "amount"]):
        z += f" + CAST({x!r} AS DOUBLE) * {c}"
    one = "CAST(1 AS DOUBLE)"
    return f"round({one} / ({one} + exp(-({z}))), 4) AS {name}"


TX_KEY_SQL = "order_key, line_no, part_key, supp_key, ship_s"

VIEWS = {
    "tx": ([], """
      SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key,
        l_suppkey AS supp_key, CAST(epoch(l_shipdate) AS BIGINT) AS ship_s,
        CAST(CAST(epoch(l_shipdate) AS BIGINT)
          - (SELECT CAST(epoch(min(l_shipdate)) AS BIGINT) FROM lineitem) AS DOUBLE) AS "time",
        l_quantity + CAST(0 AS DOUBLE) AS v1, l_discount + CAST(0 AS DOUBLE) AS v2,
        l_tax + CAST(0 AS DOUBLE) AS v3, l_extendedprice AS amount,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS class
      FROM lineitem"""),
    "tx_raw": ([], """
      SELECT l_quantity AS v1, nullif(l_discount, 0) AS v2, nullif(l_tax, 0) AS v3,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS class FROM lineitem"""),
    "records": ([], """
      SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key,
        l_suppkey AS supp_key, CAST(epoch(l_shipdate) AS BIGINT) AS ship_s,
        CAST(CAST(epoch(l_shipdate) AS BIGINT) - 804556800 AS DOUBLE) AS "time",
        l_quantity AS v1, l_discount + CAST(0 AS DOUBLE) AS v2, nullif(l_tax, 0) AS v3,
        l_extendedprice - 2000 AS amount,
        CASE l_suppkey % 6 """
        + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate([*LINEAR_SCORERS, "unknown_model"]))
        + " END AS model_name FROM lineitem"),
    "emb": ([], """
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x,
        CASE WHEN label = 0 THEN 1 ELSE 0 END AS class FROM embeddings"""),
    "wide": (["tx"], f"""
      SELECT {TX_KEY_SQL}, class AS y, {", ".join(_linear(n) for n in LINEAR_SCORERS)} FROM tx"""),
    "scores": (["wide"], " UNION ALL ".join(
        f"SELECT '{n}' AS model, y, {n} AS p FROM wide" for n in LINEAR_SCORERS)),
    "counts": (["scores"], """
      SELECT model,
        CAST(sum(CASE WHEN y = 0 AND p <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
        CAST(sum(CASE WHEN y = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN y = 1 AND p <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        CAST(sum(CASE WHEN y = 1 AND p > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp
      FROM scores GROUP BY model"""),
    "auc": (["scores"], """
      SELECT model, CASE WHEN max(np) * max(nn) > 0
          THEN sum(pos * (below + neg / CAST(2 AS DOUBLE)))
            / (CAST(max(np) AS DOUBLE) * max(nn)) END AS roc_auc
      FROM (SELECT model, pos, neg,
              sum(neg) OVER (PARTITION BY model ORDER BY p) - neg AS below,
              sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn
            FROM (SELECT model, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
                  FROM scores GROUP BY model, p))
      GROUP BY model"""),
    "rates": (["counts"], f"""
      SELECT model, {div("tp + tn", "tp + tn + fp + fn")} AS accuracy,
        {div("tp", "tp + fp")} AS "precision", {div("tp", "tp + fn")} AS recall,
        {div("2 * tp", "2 * tp + fp + fn")} AS f1, {div("tn", "tn + fp")} AS specificity,
        {div("fp", "fp + tn")} AS false_positive_rate, {div("fn", "fn + tp")} AS false_negative_rate
      FROM counts"""),
    "metrics": (["rates", "auc"], """
      SELECT model, accuracy, "precision", recall, f1, roc_auc FROM rates JOIN auc USING (model)"""),
    "curve": (["scores"], """
      SELECT model, p, pos, neg,
        sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
        row_number() OVER w AS rn, count(*) OVER (PARTITION BY model) AS total,
        sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn
      FROM (SELECT model, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg
            FROM scores GROUP BY model, p)
      WINDOW w AS (PARTITION BY model ORDER BY p DESC)"""),
    "split": (["tx"], f"""
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY h, {TX_KEY_SQL})
          <= floor(count(*) OVER (PARTITION BY class) * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE))
          THEN 'test' ELSE 'train' END AS split
      FROM (SELECT *, {hash32(SEED, *TX_KEY_SQL.split(", "))} AS h FROM tx)"""),
    "products": ([], """
      SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
        p_retailprice AS price,
        round(p_retailprice * (1 - coalesce(discount_points / CAST(reviews * 100 AS DOUBLE), 0)), 2)
          AS discount_price,
        p_size AS stock,
        CAST(1 AS DOUBLE) + CAST(4 AS DOUBLE)
          * (1 - coalesce(returned / CAST(reviews AS DOUBLE), 0)) AS rating,
        coalesce(reviews, 0) AS reviews_count, created_at
      FROM part LEFT JOIN (
        SELECT l_partkey, count(*) AS reviews,
          sum(CAST(round(l_discount * 100) AS BIGINT)) AS discount_points,
          sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned,
          min(l_shipdate) AS created_at
        FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey"""),
    "feed": ([], """
      SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
        event_type AS kind FROM events"""),
    "inter": (["feed"], f"""
      SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)"
        for k, v in INTERACTION_WEIGHTS.items())} END AS w
      FROM feed WHERE kind IN ({", ".join(f"'{k}'" for k in INTERACTION_WEIGHTS)})"""),
    "reqlog": ([], """
      SELECT event_id, ts, user_id, event_type AS endpoint, value AS duration_ms,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events"""),
    "reqs": ([], """
      SELECT c_custkey AS request_id, c_custkey AS user_id,
        CASE WHEN c_custkey % 10 <> 0 THEN split_part(p_name, ' ', 1)
          || CASE WHEN c_custkey % 3 = 0 THEN ' ' || p_type ELSE '' END END AS query,
        CASE WHEN c_custkey % 4 = 1 THEN p_type END AS category,
        CAST(1 + c_custkey % 3 AS INTEGER) AS page, 10 AS page_size,
        c_custkey % (SELECT count(*) FROM embeddings) AS query_vec_id,
        CASE WHEN c_custkey % 2 = 0 THEN (c_custkey * 3) % (SELECT count(*) FROM embeddings) END
          AS image_vec_id
      FROM customer LEFT JOIN part ON c_custkey = p_partkey"""),
}


def with_views(names: str, body: str) -> str:
    """``body`` preceded by the named views and what they build on."""
    wanted: list[str] = []

    def visit(name: str) -> None:
        needs, _ = VIEWS[name]
        for n in needs:
            visit(n)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        visit(name)
    head = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in wanted)
    return f"WITH {head}\n{body.strip()}"
