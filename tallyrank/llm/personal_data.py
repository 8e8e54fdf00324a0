"""Personal data by a skip-chain conditional random field.

Four patterns give base spans that always stay.  Tokens with a digit or an at sign are
the nodes of a random field; all other words are outside any span by rule, so they are
left out without a loss.  Neighbouring tokens form chains, and repeated or similar tokens
of a document (the same letters and digits, the same last seven digits, the same name
before an at sign) are joined by skip edges that share potentials.  Loopy message passing
in log space brings the labels of a document in line; tokens under a base span are held
at its kind.  The weights are fitted by pseudo-likelihood on base spans, so what looks
like them, stands beside them or repeats them is found where the patterns fail.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Digits of a span of several tokens, at most; addresses are one token.
DIGITS = (0, 0, 19, 15)
#: Documents with nodes that the weights are fitted on, about (twice as many at most), and nodes of one, at most.
SAMPLE, SAMPLE_NODES = 4_000, 64
#: Columns of the hashed features; features, keys and numbers that place a node (start, end, digits, barred label).
WIDTH, FEATURES, KEYS, PLACE = 1_024, 7, 3, 4
#: Rounds of message passing, and the share of the old message that is kept.
ROUNDS, DAMPING = 24, 0.5
#: Agreement of joined tokens that the fit is drawn to: a corpus without repeats doesn't show it.
AGREE = 2.0
#: Probability of its kind from which a token is added.
SURE = 0.8

# Fixed values of the base patterns.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Digits before a failing start fail alike, so a start inside a run of digits is never tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Characters of a token.
_TOKEN = _LOCAL + "@()"
_REST = re.compile(r"[A-Za-z0-9._%+\-@()]*")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_]+(?=\W*\Z)")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Matches around at signs: the pattern has one, and nothing before it can hold one."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the base patterns' matches, in order; kinds by their place in ``KINDS``."""
    out = [(start, 0, end) for start, end in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of token characters that hold a digit or an at sign."""
    out, free = [], 0
    m = _MARK.search(text)
    while m:
        start = free + len(text[free:m.start()].rstrip(_TOKEN))
        free = _REST.match(text, m.end()).end()
        # Closing punctuation belongs to the sentence.
        end = start + len(text[start:free].rstrip(".-%+_("))
        out.append((start, max(end, m.end())))
        m = _MARK.search(text, free)
    return out


def _shape(token: str) -> str:
    """Runs of letters and digits by length class, other characters as they are."""
    out = []
    for m in re.finditer("[A-Za-z]+|[0-9]+|.", token[:64], re.S):
        run = m.group()
        if run[0].isdigit():
            n = len(run)
            out.append("9" * n if n <= 4 else "9a" if n <= 8 else "9b" if n <= 11 else "9c" if n <= 19 else "9d")
        else:
            out.append("a" if run[0].isalpha() else run)
    return "".join(out)


def _barred(token: str) -> int:
    """The label that a token can't have as its own check fails, or 0: a card's digits, an address' parts."""
    digits = _NOT_DIGIT.sub("", token)
    if 12 <= len(digits) and len(digits) >= len(token) - 3 and not (len(digits) <= 19 and luhn(digits)):
        return 3
    return 2 if _IP.fullmatch(token) else 0  # one that passes is under a base span


def _column(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}={value}") % WIDTH


def _features(text: str, start: int, end: int, before: int, after: int) -> list[int]:
    """Hashed columns of a token: its shape, coarse shape, checks, and the words around it."""
    token = text[start:end]
    shape, digits = _shape(token), _NOT_DIGIT.sub("", token)
    card = 12 <= len(digits) <= 19 and len(digits) >= len(token) - 3
    word = _WORD.search(text[max(0, start - 24):start])
    gap = text[max(before, start - 4):start], text[end:min(after, end + 4)]
    return [
        _column("shape", shape), _column("coarse", re.sub("(9[abcd]?)+", "9", re.sub("(a+9+)+a*|9+a+(9+a*)*", "x", shape))),
        _column("digits", f"{min(len(digits), 20)} {len(digits) == len(token)}"),
        _column("check", f"{card and luhn(digits)} {card} {_IP.fullmatch(token) is not None} {token.count('@')} {token[:1] in '+('}"),
        _column("word", word.group().lower() if word else ""),
        _column("gap", f"{'|'.join(_shape(g) for g in gap)}"), _column("length", str(min(end - start, 40) // 4)),
    ]


def _keys(token: str) -> list[int]:
    """Hashes under which a token is the same as or similar to others; 0 where it has none."""
    letters = "".join(c for c in token.lower() if c.isalnum())
    digits = _NOT_DIGIT.sub("", token)
    name = token.lower().partition("@")[0] if "@" in token else ""
    found = (letters if len(letters) >= 4 else "", digits[-7:] if len(digits) >= 7 else "", name if len(name) >= 4 else "")
    return [xxhash.xxh3_64_intdigest(f"{i}{k}") >> 1 if k else 0 for i, k in enumerate(found)]


def _described(text: str) -> tuple:
    """Base spans of a text, and its nodes: place, label (-1 unless under a base span), chain, features, keys."""
    spans = base_spans(text)
    found = tokens(text)
    labels, chained, features, keys = [], [], [], []
    at = 0
    for i, (start, end) in enumerate(found):
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        # Spans of different kinds may overlap, so later ones are looked at as well.
        over = [s for s in spans[at:at + 4] if s[0] < end and start < s[2]]
        labels.append(over[0][1] + 1 if over else -1)
        before = found[i - 1][1] if i else 0
        chained.append(bool(i) and start - before <= 2 and not text[before:start].strip(" ,;:/"))
        features.append(_features(text, start, end, before, found[i + 1][0] if i + 1 < len(found) else len(text)))
        keys.append(_keys(text[start:end]))
    return spans, found, labels, chained, features, keys


_NODES = ("doc_id long, base array<int>, places array<int>, labels array<int>, chained array<int>, "
          "features array<int>, keys array<long>")


def _read(batches):
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column("text"):
            text = text.as_py() or ""
            spans, found, labels, chained, features, keys = _described(text)
            places = [(start, end, len(_NOT_DIGIT.sub("", text[start:end])), _barred(text[start:end])) for start, end in found]
            for c, flat in zip(columns, (spans, places, labels, chained, features, keys)):
                c.append([x for s in flat for x in s] if flat and isinstance(flat[0], (tuple, list)) else [int(x) for x in flat])
        arrays = [pa.array(c, pa.list_(pa.int64() if i == 5 else pa.int32())) for i, c in enumerate(columns)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays],
                                         ["doc_id", "base", "places", "labels", "chained", "features", "keys"])


def skip_edges(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Pairs of nodes of one document that share a key: each occurrence with the next one, each pair once."""
    pairs = [np.zeros((0, 2), np.int64)]
    for column in keys.T:
        held = np.flatnonzero(column)
        held = held[np.lexsort((held, column[held], owner[held]))]
        same = (column[held[1:]] == column[held[:-1]]) & (owner[held[1:]] == owner[held[:-1]])
        pairs.append(np.stack([held[:-1][same], held[1:][same]], axis=1))
    return np.unique(np.concatenate(pairs), axis=0)


class Field:
    """Weights: of each feature and label, of labels of chained tokens, of labels of joined tokens."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, features: np.ndarray, labels: np.ndarray, chains: np.ndarray, skips: np.ndarray,
                  barred: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of the labels of every node after ``ROUNDS`` rounds of message passing.

        ``labels`` from 0 on are held; ``barred`` labels above 0 are ruled out.  A node's
        result depends on its own document alone.
        """
        own = self.unary[features].sum(axis=1)
        if barred is not None:
            own[barred > 0, barred[barred > 0]] = -1e9
        held = labels >= 0
        own[held] = -1e9
        own[held, labels[held]] = 0.0
        pairs = np.concatenate([chains, skips])
        potentials = np.concatenate([np.broadcast_to(self.chain, (len(chains), *self.chain.shape)),
                                     np.broadcast_to(self.skip, (len(skips), *self.skip.shape))])
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        target = np.concatenate([pairs[:, 1], pairs[:, 0]])
        potentials = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
        opposite = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        message = np.zeros((len(source), own.shape[1]))
        for _ in range(ROUNDS if len(pairs) else 0):
            belief = own.copy()
            np.add.at(belief, target, message)
            sent = (belief[source] - message[opposite])[:, :, None] + potentials
            top = sent.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(sent - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        np.add.at(own, target, message)
        own = np.exp(own - own.max(axis=1, keepdims=True))
        return own / own.sum(axis=1, keepdims=True)


def fit_field(features: np.ndarray, labels: np.ndarray, chains: np.ndarray, skips: np.ndarray,
              steps: int = 300, rate: float = 0.1, ridge: float = 2e-4) -> Field:
    """Weights of the greatest pseudo-likelihood: each label given its neighbours' labels."""
    n, many = max(1, len(labels)), len(KINDS) + 1
    labels = np.maximum(labels, 0)
    shapes = [(WIDTH, many), (many, many), (many, many)]
    prior = [np.zeros(shapes[0]), np.zeros(shapes[1]), AGREE * np.eye(many)]
    weights = [w.copy() for w in prior]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    one = np.eye(many)[labels]
    columns = features.ravel()
    for step in range(1, steps + 1):
        unary, chain, skip = weights
        score = unary[features].sum(axis=1)
        np.add.at(score, chains[:, 1], chain[labels[chains[:, 0]]])
        np.add.at(score, chains[:, 0], chain.T[labels[chains[:, 1]]])
        for a, b in ((0, 1), (1, 0)):
            np.add.at(score, skips[:, b], skip[labels[skips[:, a]]])
        score = np.exp(score - score.max(axis=1, keepdims=True))
        wrong = score / score.sum(axis=1, keepdims=True) - one
        pulls = [np.zeros(s) for s in shapes]
        np.add.at(pulls[0], columns, np.repeat(wrong, features.shape[1], axis=0))
        np.add.at(pulls[1], labels[chains[:, 0]], wrong[chains[:, 1]])
        np.add.at(pulls[1].T, labels[chains[:, 1]], wrong[chains[:, 0]])
        np.add.at(pulls[2], labels[skips[:, 0]], wrong[skips[:, 1]])
        np.add.at(pulls[2], labels[skips[:, 1]], wrong[skips[:, 0]])
        pulls[2] = (pulls[2] + pulls[2].T) / 2
        for i, pull in enumerate(pulls):
            pull = pull / n + ridge * (weights[i] - prior[i])
            first[i] = 0.9 * first[i] + 0.1 * pull
            second[i] = 0.999 * second[i] + 0.001 * pull ** 2
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-9)
    return Field(*weights)


def _joined(places: list[np.ndarray], chained: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document of every node, chain edges and skip edges of documents laid end to end."""
    owner = np.repeat(np.arange(len(places)), [len(p) // PLACE for p in places])
    second = np.flatnonzero(chained)
    return owner, np.stack([second - 1, second], axis=1), skip_edges(keys.reshape(-1, KEYS), owner)


def learn(nodes: DataFrame) -> Field:
    """The field of about ``SAMPLE`` documents with nodes, and the first ``SAMPLE_NODES`` nodes of each."""
    few = nodes.where(F.size("labels") > 0)
    mixed = F.xxhash64("doc_id", "features", "keys")
    # Few rows pass the hash, so that few are sorted wherever they lie.
    few = few.where(F.pmod(mixed, F.lit(2 ** 40)) <= int(2 ** 40 * min(1.0, SAMPLE / max(1, few.count()))))
    few = few.select(*[F.slice(c, 1, SAMPLE_NODES * m).alias(c) for c, m in (
        ("places", PLACE), ("labels", 1), ("chained", 1), ("features", FEATURES), ("keys", KEYS))], mixed.alias("order"))
    rows = few.orderBy("order", "labels", "places").limit(2 * SAMPLE).collect()
    flat = {c: np.array([x for r in rows for x in r[c]], np.int64) for c in ("labels", "chained", "features", "keys")}
    _, chains, skips = _joined([np.array(r["places"]) for r in rows], flat["chained"], flat["keys"])
    return fit_field(flat["features"].reshape(-1, FEATURES), flat["labels"], chains, skips)


def _added(found: np.ndarray, labels: np.ndarray, chained: np.ndarray, likely: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of runs of chained tokens, outside base spans, that are of one kind for sure.

    A run is cut before it has more digits than its kind.
    """
    out: list[list[int]] = []
    held = 0
    kind = likely.argmax(axis=1)
    sure = (labels < 0) & (kind > 0) & (likely[np.arange(len(kind)), kind] >= SURE)
    for i in np.flatnonzero(sure):
        start, end, digits, _ = found[i].tolist()
        held += digits
        if out and chained[i] and sure[i - 1] and kind[i - 1] == kind[i] and held <= DIGITS[kind[i] - 1]:
            out[-1][2] = end
        else:
            out.append([start, int(kind[i]) - 1, end])
            held = digits
    return [tuple(s) for s in out]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def _labelled(sent):
    def run(batches):
        for batch in batches:
            places = [np.array(p, np.int64).reshape(-1) for p in batch.column("places").to_pylist()]
            flat = {c: batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("labels", "chained", "features", "keys")}
            owner, chains, skips = _joined(places, flat["chained"], flat["keys"])
            barred = np.concatenate([p.reshape(-1, PLACE)[:, 3] for p in places]) if places else np.zeros(0, np.int64)
            likely = sent.value.marginals(flat["features"].reshape(-1, FEATURES), flat["labels"], chains, skips, barred)
            ends = np.searchsorted(owner, np.arange(len(places) + 1))
            counts, digests, spans, added = [], [], [], []
            for i, base in enumerate(batch.column("base").to_pylist()):
                base = list(zip(base[::3], base[1::3], base[2::3]))
                part = slice(ends[i], ends[i + 1])
                more = _added(places[i].reshape(-1, PLACE), flat["labels"][part], flat["chained"][part], likely[part])
                counts.append([sum(s[1] == k for s in base) for k in range(len(KINDS))])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + more))
                added.append(len(more))
            counts = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, np.ascontiguousarray(counts.T)), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` of every row of ``docs``.

    ``docs`` has ``doc_id, text``; a null text counts as empty and has no spans; other
    columns play no part.  The counts and the digest are of the base spans, which the
    patterns give leftmost and without overlap for each kind; ``spans`` holds these and
    the ones the field adds, ``n_added`` of them, none over a base span.  Places are code
    points, ends exclusive.  Rows that share a ``doc_id`` are documents of their own, and
    equal texts get equal spans; no rows give none.

    Each text is read once, whole, and only its nodes are kept; message passing works on
    whole batches of documents at a time, at a cost in proportion to their nodes, as each
    occurrence of a token is joined with the next one only.
    """
    spark = docs.sparkSession
    nodes = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_read, _NODES)
    nodes = materialize(nodes, "nodes")
    sent = spark.sparkContext.broadcast(learn(nodes))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return nodes.mapInArrow(_labelled(sent), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
