"""Toxicity of texts by a weighted finite-state pattern grammar.

Words are read by five small transducers: insults, threats, targets, negation and
reported speech.  A clause machine composes them: it carries whether a target was
met, how far back a negation or a verb of saying lies, and emits the clause's matches
by kind.  A document is scored by its matched clauses; an insult in a clause without a
target is a match of a kind of its own, so a lone word scores.  The insult words and
the weights of the kinds are learned from labelled documents.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize

#: Labelled documents that the lexicon and the weights are learned from, at most.
LABELLED = 20_000

# Fixed values of the grammar.
TARGETS = frozenset("you your yours yourself u he him his she her they them their we us i me these those people everyone "
                    "du dich dir ihr euch sie tu te toi vous tus ti usted ustedes vosotros".split())
THREATS = frozenset("kill killing murder hurt destroy beat shoot stab burn strangle hang punch smash crush attack".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't didn't nicht kein keine nie "
                      "ne pas jamais nunca jamás tampoco".split())
REPORTS = frozenset("said says say called calls call wrote writes claimed claims reported quoted quote alleged "
                    "sagte nannte dit appelle dijo llama".split())

#: Letters of a stem: an insult is accepted as a whole word or by its first letters.
STEM = 5
#: How many words a negation or a verb of saying reaches.
REACH = 4
KINDS = ("insult", "targeted insult", "threat", "denied", "reported")
#: Weights that the fit is drawn to: what the labels don't show stays as here.
PRIOR = np.array([1.5, 1.0, 2.0, -0.5, -0.5])
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


def _stem(word: str) -> str:
    return word[:STEM] + "*"


def _units(text: str | None) -> set[str]:
    """The distinct words of a text and their stems."""
    own = set(_WORD.findall((text or "").lower()))
    return own | {_stem(w) for w in own if len(w) >= STEM}


def clause_matches(words: list[str], insults: dict[str, float]) -> np.ndarray:
    """The weight of a clause's matches by kind, read once from left to right.

    A denied or reported insult counts as one and as denied or reported, so that its
    kind's weight lowers it.
    """
    out = np.zeros(len(KINDS))
    target = any(w in TARGETS for w in words)
    denied = reported = -REACH - 1
    for i, w in enumerate(words):
        if w in NEGATIONS:
            denied = i
        elif w in REPORTS:
            reported = i
        threat = w in THREATS and target
        weight = max(insults.get(w, 0.0), insults.get(_stem(w), 0.0), float(threat))
        if weight:
            if i - denied <= REACH:
                out[3] += weight
            elif i - reported <= REACH:
                out[4] += weight
            elif threat:
                out[2] += weight
            out[0 if not target else 1] += 0 if threat else weight
    return out


def matches(text: str | None, insults: dict[str, float]) -> np.ndarray:
    """Square roots of the summed weights of a text's matched clauses, by kind."""
    out = np.zeros(len(KINDS))
    if not text:
        return out
    met = _units(text)
    if met.isdisjoint(insults) and met.isdisjoint(THREATS):
        return out
    for clause in _CLAUSE.split(text.lower()):
        out += clause_matches(_WORD.findall(clause), insults)
    return np.sqrt(out)


def _counted(batches):
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = _units(text)
            words += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int64())], ["word", "toxic"])


def _met(looked: dict[str, int]):
    def run(batches):
        for batch in batches:
            own = [[looked[w] for w in _units(t) if w in looked] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], ["words"])

    return run


def _matched(insults: dict[str, float]):
    def run(batches):
        for batch in batches:
            found = [matches(t, insults) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([list(f) for f in found], pa.list_(pa.float64()))], ["toxic", "found"])

    return run


def _explaining(words: np.ndarray, docs: np.ndarray, n_words: int) -> list[int]:
    """Numbers of the words chosen greedily until every document is explained by three.

    ``words`` and ``docs`` are the pairs of a word and a document that holds it.  The
    word that explains most documents comes first, of equal ones that of the larger
    number; one that explains fewer than four is not chosen.
    """
    held = docs[np.argsort(words, kind="stable")]
    ends = np.cumsum(np.bincount(words, minlength=n_words))
    starts = np.append(0, ends[:-1])
    needs, chosen = np.full(docs.max(initial=-1) + 1, 3), []
    heap = [(-int(e - s), -w) for w, (s, e) in enumerate(zip(starts, ends))]
    heapq.heapify(heap)
    while heap:
        w = -heapq.heappop(heap)[1]
        holding = held[starts[w]:ends[w]]
        gain = int((needs[holding] > 0).sum())
        if gain < 4:
            continue  # gains only fall
        if heap and gain < -heap[0][0]:
            heapq.heappush(heap, (-gain, -w))  # its count was stale: the next best may lead now
            continue
        chosen.append(w)
        needs[holding] -= 1
    return chosen


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """Words and stems that toxic documents hold beyond chance, by the documents they explain.

    ``sample`` is counted by distinct texts, so copies of a text weigh as one; a text
    labelled both ways is what most of its labels say.  Every document is explained by
    its three strongest words, so the other words of a long toxic text with many near
    copies do not enter.  No word that passes the filter is left out of the choice.
    """
    sample = sample.groupBy("text").agg((F.avg("toxic") >= 0.5).cast("long").alias("toxic"))
    sample = materialize(sample, "labelled-texts")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return {}
    counts = sample.mapInArrow(_counted, "word string, toxic long").groupBy("word").agg(
        F.sum("toxic").alias("a"), F.count("*").alias("n")).where("a >= 4 and a * 2 >= n")
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (toxic - F.col("a") + 0.5)) - F.log(b / (total - toxic - F.col("n") + F.col("a") + 0.5))
    counts = counts.withColumn("odds", odds).withColumn("sure", odds - 2 * F.sqrt(1 / a + 1 / b)).where("sure > 1")
    best = dict(sorted((r.word, r.odds) for r in counts.select("word", "odds").collect()))
    if not best:
        return {}
    words = list(best)
    met = sample.where("toxic = 1").mapInArrow(_met({w: i for i, w in enumerate(words)}), "words array<int>")
    own = met.toArrow().column("words").combine_chunks()
    docs = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
    chosen = {words[w]: best[words[w]] for w in _explaining(own.flatten().to_numpy(), docs, len(words))}
    top = max(chosen.values(), default=1.0)
    return {w: v / top for w, v in chosen.items()}


def _weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights and offset, drawn to ``PRIOR``, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(PRIOR, -3.0)
    w, pull = prior.copy(), np.full(len(prior), 1.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> tuple[dict[str, float], np.ndarray]:
    """The insult lexicon and the weights, from at most ``limit`` labelled documents.

    Labels other than 0 and 1 and rows without ``doc_id`` are passed over.  Without
    both labels the lexicon is empty and the weights are the prior ones.
    """
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long")).agg(
        F.max("toxic").cast("long").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` ids, so they are sent to the documents.
    sample = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(sample.select("text", "toxic"), "labelled")
    insults = _lexicon(sample)
    rows = sample.mapInArrow(_matched(insults), "toxic long, found array<double>").collect()
    x = np.array([r.found for r in rows]).reshape(-1, len(KINDS))
    return insults, _weights(x, np.array([r.toxic for r in rows], float))


def _scored(insults: dict[str, float], weights: np.ndarray):
    def run(batches):
        for batch in batches:
            x = np.array([matches(t, insults) for t in batch.column("text").to_pylist()]).reshape(-1, len(KINDS))
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def toxicity(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """``docs`` with ``score``, 0 to 1, of every whole text; a column of that name is replaced.

    A null or empty text has no clauses and scores as a clean one.  Rows are scored by
    themselves: repeated rows score alike, no rows give none, and only ``text`` is read.
    """
    docs = docs.drop("score")
    kept = docs.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_scored(*model), schema + ", score double")
