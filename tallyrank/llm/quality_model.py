"""Quality of texts, learned from trusted good ones and unlabelled ones.

A logistic model of text statistics minimises the non-negative unbiased risk of
positive-unlabelled learning: good documents count as good with the class prior,
every document counts as bad, less what the good ones among them add.  Rows labelled
bad are never shown to the fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize

STEPS = 14
RIDGE = 1e-4
_SYMBOLS = re.compile(r"[#$%&*@^~=+<>{}\[\]\\]")
_OTHER = re.compile(r"[|_/]")
_LETTERS = re.compile(r"[^\W\d_]")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all are finite, also for an empty one."""
    text = text or ""
    words, n_chars = text.split(), max(1, len(text))
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    distinct = len(counts) / n
    letters = len(_LETTERS.findall(text)) / n_chars
    length = sum(map(len, words)) / n
    return [
        math.log1p(len(words)), distinct, distinct * distinct, math.log1p(len(counts)) / math.log1p(n + 1),
        max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / n_lines, min(length, 20.0), min(length, 20.0) ** 2 / 20, letters, letters * letters,
        len(_SYMBOLS.findall(text)) / n_chars, len(_OTHER.findall(text)) / n_chars, sum(map(str.isdigit, text)) / n_chars,
        (text.count(".") + text.count(",")) / n, math.log1p(n / n_lines), float(len(words) < 20), float(distinct < 0.5),
    ]


N = 18


def _described(batches):
    for batch in batches:
        found = [statistics(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` with the text statistics of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _described, "doc_id long, x array<double>")


def _standard(x, mean, spread) -> np.ndarray:
    z = np.clip((np.asarray(x, float).reshape(-1, N) - mean) / spread, -6, 6)
    return np.hstack([z, np.ones((len(z), 1))])


def _sums(mean, spread, w):
    """Of the rows of a task: moments, or the risk's sums at ``w`` for unlabelled and good rows."""

    def run(batches):
        m = N + 1
        size = 2 * N + 1 if w is None else 4 + 3 * m + m * m
        total = np.zeros(size)
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, N)
            if w is None:
                total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
                continue
            z = _standard(x, mean, spread)
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            f = z @ w
            p, loss = 1 / (1 + np.exp(-np.clip(f, -30, 30))), np.logaddexp(0, f)
            g = z[good]
            total += np.concatenate([
                [len(z), loss.sum()], z.T @ p, ((z * (p * (1 - p))[:, None]).T @ z).ravel(),
                [len(g), loss[good].sum()], g.T @ p[good], g.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    return run


def _added(rows: DataFrame, fn) -> np.ndarray:
    """Sums over all rows; each task sends one short list, and Spark adds them place by place."""
    parts = rows.mapInArrow(fn, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col"))
    found = dict(parts.collect())
    return np.array([found[i] for i in range(len(found))])


def fit(described: DataFrame, labels: DataFrame) -> dict:
    """Weights from ``labels`` (``doc_id, quality``) over all described documents.

    Good are the documents with label 1; unlabelled are all documents.  The class
    prior is the share of label 1 among the labels.  Newton steps go down the unbiased
    risk, which is convex for the logistic loss; where the part of it that stands for
    bad documents falls below zero, the step goes back up on that part instead.
    Without any label 1, every text scores the prior, or a half if there is no label.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long")).agg(
        F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    prior = min(0.98, max(0.02, good / n)) if n else 0.5
    moments = _added(described, _sums(None, None, None))
    count = max(1.0, moments[0]) if len(moments) else 1.0
    mean = moments[1:N + 1] / count if len(moments) else np.zeros(N)
    spread = np.sqrt(np.maximum(moments[N + 1:] / count - mean * mean, 1e-8)) if len(moments) else np.ones(N)
    w = np.zeros(N + 1)
    w[-1] = math.log(prior / (1 - prior))
    if not good:
        return {"w": w, "mean": mean, "spread": spread, "prior": prior}
    good_ids = known.where("quality = 1").select("doc_id", F.lit(True).alias("good"))
    rows = materialize(described.join(good_ids, "doc_id", "left").select(
        "x", F.coalesce("good", F.lit(False)).alias("good")), "statistics")
    m = N + 1
    for _ in range(STEPS):
        s = _added(rows, _sums(mean, spread, w))
        n_u, loss_u, p_u, h = s[0], s[1], s[2:2 + m], s[2 + m:2 + m + m * m].reshape(m, m)
        n_g, loss_g, p_g, x_g = s[2 + m + m * m], s[3 + m + m * m], s[4 + m + m * m:4 + 2 * m + m * m], s[4 + 2 * m + m * m:4 + 3 * m + m * m]
        if not n_g:
            break
        bad = loss_u / n_u - prior * loss_g / n_g
        if bad < 0:
            step = -(p_u / n_u - prior * p_g / n_g)
        else:
            # The logistic losses of f and -f differ by f, so good rows add a linear term.
            gradient = p_u / n_u - prior * x_g / n_g + RIDGE * w
            step = np.linalg.solve(h / n_u + RIDGE * np.eye(m), gradient)
        longest = np.abs(step).max()
        w = w - step * min(1.0, 1.5 / max(longest, 1e-12))
        if longest < 1e-6:
            break
    return {"w": w, "mean": mean, "spread": spread, "prior": prior}


def _scored(model: dict):
    def run(batches):
        for batch in batches:
            z = _standard(batch.column("x").to_pylist(), model["mean"], model["spread"])
            score = 1 / (1 + np.exp(-np.clip(z @ model["w"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def quality(described: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score`` of every described row, 0 to 1.

    A null or empty text has the statistics of no words.  Rows are scored by
    themselves: repeated rows score alike, no rows give none.
    """
    return described.mapInArrow(_scored(model), "doc_id long, score double")
