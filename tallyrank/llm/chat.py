"""Conversations as training text, in turn-aligned windows of a token budget.

Prefix sums of the turns' tokens deal the turns to windows.  Every window opens with
the conversation's system turn and a limited history, both marked as repeated and
outside the loss; under the loss is each assistant text once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 512, 128
#: Tokens that a turn costs besides its words.
TURN_COST = 4
#: Turns whose prefix sums are taken together.
BLOCK = 256
WORDS = r"[^\x20\x09-\x0D]+"
#: The template: a turn opens, its text follows on lines of its own, and it closes.
OPEN, AGAIN, CLOSE = "<turn ", "again ", "</turn>\n"


def escaped(text):
    """Text in which no control string can begin; ``unescaped`` takes it back."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text):
    text = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, text, loss, n_tokens`` of ``conv_id, turn, role, text`` rows.

    Turns go by ``turn``, null first, ties by role and text; null roles and texts are
    empty; repeated rows are turns of their own; a null ``conv_id`` is a conversation.
    Other columns play no part; no rows give none.  ``loss`` lists the code points
    ``begin`` up to ``end`` of ``text`` that are under the loss.  A window holds no more
    than ``budget`` tokens unless a turn that fills it alone is longer; such a turn
    stays whole.  A system turn or history that leaves no room gets what it needs.

    Turns of a long conversation are summed in blocks and dealt by window, so no task
    holds more of it than a block or a window.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = turns.select(
        key.alias("key"), F.col("conv_id").cast("long"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))).alias("block"),
        F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("cost", F.regexp_count("text", F.lit(WORDS)).cast("long") + TURN_COST)
    blocks = rows.groupBy("key", "block").agg(F.sum("cost").alias("cost"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("key", "block", F.coalesce(F.sum("cost").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, ["key", "block"]).withColumn(
        "begin", F.col("before") + F.sum("cost").over(within) - F.col("cost")).drop("block", "before", "turn")

    head = rows.where((F.col("begin") == 0) & (F.col("role") == "system")).select(
        "key", F.col("text").alias("system"), F.col("cost").alias("system_cost"))
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("system_cost", F.lit(0)))
    rows = rows.join(head.select("key", "system_cost"), "key", "left").withColumn("stride", stride)
    # A turn that starts in one stretch of the prefix sums and ends in the next has a window of its own.
    stretch = F.floor(F.col("begin") / F.col("stride"))
    across = (F.col("begin") + F.col("cost") > (stretch + 1) * F.col("stride")).cast("long")
    rows = rows.withColumn("window", 2 * stretch + across).drop("stride", "system_cost")

    own = rows.groupBy("key", "window").agg(F.min("begin").alias("first"))
    told = own.where("first > 0")
    system = told.join(head, "key").select("key", "window", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("begin"),
                                           F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_cost").alias("cost"))
    # What lies at most ``history`` tokens back is in the stretch of that length at hand or the one before.
    at = F.floor(F.col("first") / history)
    near = told.withColumn("near", F.explode(F.array(at, at - 1)))
    past = rows.withColumn("near", F.floor(F.col("begin") / history)).drop("window")
    past = past.where(~((F.col("begin") == 0) & (F.col("role") == "system"))).drop("conv_id")
    past = near.join(past, ["key", "near"]).where(
        (F.col("begin") < F.col("first")) & (F.col("first") - F.col("begin") <= history))
    columns = ["key", "window", "kind", "begin", "role", "text", "cost"]
    pieces = rows.withColumn("kind", F.lit(2)).select(columns).union(system.select(columns)).union(
        past.withColumn("kind", F.lit(1)).select(columns))

    repeated = F.col("kind") < 2
    opening = F.concat(F.lit(OPEN), F.when(repeated, F.lit(AGAIN)).otherwise(F.lit("")), escaped(F.col("role")), F.lit(">\n"))
    body = escaped(F.col("text"))
    pieces = pieces.withColumn("opening", opening).withColumn("body", body)
    pieces = pieces.withColumn("piece", F.concat("opening", "body", F.lit("\n" + CLOSE)))
    order = Window.partitionBy("key", "window").orderBy("kind", "begin").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("piece")).over(order) - F.length("piece") + F.length("opening")
    pieces = pieces.withColumn("start", start)
    target = (F.col("kind") == 2) & (F.col("role") == "assistant")
    span = F.when(target, F.struct(F.col("start").alias("begin"), (F.col("start") + F.length("body")).alias("end")))
    pieces = pieces.select("key", "window", "cost", F.struct("kind", "begin", "piece", span.alias("span")).alias("p"))
    out = pieces.groupBy("key", "window").agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("cost").alias("n_tokens"))
    conv = F.when(F.col("key") != "", F.substring("key", 2, 20).cast("long"))
    return out.select(conv.alias("conv_id"), "window", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
                      F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"), "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """The conversations that ``windows`` formatted, read from the texts and loss spans alone.

    ``conv_id, n_turns, turns, loss, formatted_chars``: ``turns`` is role and text of every
    turn, each on a line of its own; ``loss`` all text under the loss.  Both are whole, as
    is anything that is digested in one piece.
    """
    parts = F.slice(F.split("text", CLOSE), 1, F.size(F.split("text", CLOSE)) - 1)
    fresh = F.filter(parts, lambda x: ~x.startswith(OPEN + AGAIN))
    cut = F.transform(fresh, lambda x: F.concat(
        unescaped(F.regexp_extract(x, r"(?s)^<turn ([^>]*)>\n", 1)), F.lit("\n"),
        unescaped(F.regexp_extract(x, r"(?s)^<turn [^>]*>\n(.*)\n$", 1)), F.lit("\n")))
    target = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["begin"] + 1, s["end"] - s["begin"])))
    rows = formatted.select("conv_id", "window", F.size(fresh).alias("n"), F.array_join(cut, "").alias("turns"),
                            F.array_join(target, "").alias("loss"), F.length("text").alias("chars"))
    rows = rows.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"),
                                       F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return rows.select("conv_id", "n_turns", joined("turns").alias("turns"), joined("loss").alias("loss"), "formatted_chars")


#: The digests and sizes in DuckDB SQL over a table ``conversations``.
SQL = r"""
WITH raw AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
             SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL
             SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM raw),
c AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS cost,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
             length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
             + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) + 17 AS size FROM r),
b AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY n) - cost AS begin FROM c),
h AS (SELECT conv_id, cost AS system_cost, size AS system_size FROM b WHERE begin = 0 AND role = 'system'),
w AS (SELECT b.*, h.system_size, greatest(1, 384 - coalesce(h.system_cost, 0)) AS stride
      FROM b LEFT JOIN h ON b.conv_id IS NOT DISTINCT FROM h.conv_id),
v AS (SELECT *, 2 * floor(begin / stride) + (begin + cost > (floor(begin / stride) + 1) * stride)::INT AS win FROM w),
o AS (SELECT conv_id, win, min(begin) AS first, max(system_size) AS system_size FROM v GROUP BY ALL),
p AS (SELECT o.conv_id, sum(b.size + 6) AS chars FROM o JOIN b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
      AND b.begin < o.first AND o.first - b.begin <= 128 AND NOT (b.begin = 0 AND b.role = 'system')
      WHERE o.first > 0 GROUP BY 1),
s AS (SELECT conv_id, sum(system_size + 6) AS chars FROM o WHERE first > 0 AND system_size IS NOT NULL GROUP BY 1),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
             sum(size) AS chars FROM b GROUP BY conv_id)
SELECT t.conv_id, t.n_turns, t.turns_sha256, t.loss_chars, t.loss_sha256,
       (t.chars + coalesce(p.chars, 0) + coalesce(s.chars, 0))::BIGINT AS formatted_chars
FROM t LEFT JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id LEFT JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
"""
