"""Base spans against the plain patterns, message passing against enumeration, the query against a slow form."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tallyrank.llm import personal_data as pd_
from tallyrank.llm.personal_data import KINDS, KEYS, WIDTH, Field, base_spans, personal_data, skip_edges, tokens

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def checked(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == 1:
        return all(int(p) <= 255 for p in match.split("."))
    if kind == 2:
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS)
                  for m in re.finditer(p, text) if checked(k, m.group()))


def said(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def random_text(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "x.y+z@mail.example.com", "@d.e", "@", "a@b", "a@b..c", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.4",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0123", "+44 20 7946 0958 99 12 34", "+", "7", " ", "-", ".",
             "é", "word", "_", "4111111111111111", "+4111111111111111", "00000000000000", "\n"]
    return "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randrange(14)))


@pytest.mark.parametrize("seed", range(20))
def test_base_spans_are_those_of_the_plain_patterns(seed):
    for i in range(200):
        text = random_text(seed * 1000 + i)
        assert base_spans(text) == plain(text), text


def test_long_runs_cost_their_length():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1 " * 100_000, "a@" * 150_000, "(" * 300_000):
        assert len(base_spans(run)) < 40_000
        assert len(tokens(run)) <= 100_001


def exact(own, pairs):
    """Marginals by all labellings."""
    n, many = own.shape
    out = np.zeros_like(own)
    for y in itertools.product(range(many), repeat=n):
        p = np.exp(sum(own[i, y[i]] for i in range(n)) + sum(w[y[a], y[b]] for a, b, w in pairs))
        for i in range(n):
            out[i, y[i]] += p
    return out / out.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_holds_clamped_nodes():
    rng = np.random.default_rng(1)
    unary, chain, skip = rng.normal(size=(WIDTH, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    features = rng.integers(0, WIDTH, (5, 7))
    chains, skips = np.array([[0, 1], [1, 2]]), np.array([[2, 4], [1, 3]])
    got = Field(unary, chain, skip).marginals(features, np.full(5, -1), chains, skips)
    own = unary[features].sum(axis=1)
    pairs = [(a, b, chain) for a, b in chains] + [(a, b, skip) for a, b in skips]
    assert np.abs(got - exact(own, pairs)).max() < 1e-4
    held = Field(unary, chain, skip).marginals(features, np.array([-1, 2, -1, -1, -1]), chains, skips)
    own[1] = -1e3
    own[1, 2] = 0
    assert held[1, 2] == 1 and np.abs(held - exact(own, pairs)).max() < 1e-4


def test_skip_edges_join_each_occurrence_with_the_next_in_its_document():
    keys = np.zeros((6, KEYS), np.int64)
    keys[[0, 2, 3, 5], 0] = 9
    keys[[0, 2], 1] = 8
    assert skip_edges(keys, np.array([0, 0, 0, 0, 1, 1])).tolist() == [[0, 2], [2, 3]]


SCHEMA = "doc_id long, text string, spans string, labels int"
PHONE, CARD = "+1 (212) 555-0123", "4111 1111 1111 1111"


def documents():
    rng = random.Random(4)
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011000990139424"]
    rows = [(i, f"write to me.{i}@mail{i % 7}.example.com or call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04} of "
                f"{rng.randrange(1, 255)}.{rng.randrange(1, 255)}.3.{i % 250} {rng.choice('ab cd ef gh see of'.split())} {rng.choice(cards)} {rng.choice('ij kl mn'.split())} version {i % 9}.{i % 4} part {i}", "x", 1)
            for i in range(300)]
    return rows + [(1000, "call +1 (269) 555-3296 4111111111111111 now", "x", 1), (1001, None, "x", 1), (1002, "", "x", 1),
                   (None, "a@b.c", "x", 1), (1003, "no data here", "x", 1), (1003, "no data here", "x", 1),
                   (1004, "me@x.org " * 3000 + "9 " * 3000, "x", 1), (1005, "version 4.0 of part 7", "x", 1),
                   (1006, "call +1 (269) 555-3296 or by hand (269) 555-3296 now", "x", 1), (1007, "see 4111111111111112 kl", "x", 1)]


def test_adds_what_patterns_miss_and_leaves_the_rest(spark):
    rows = documents()
    got = personal_data(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {(i, hashlib.sha256(said(plain(t or "")).encode()).hexdigest()): t or "" for i, t, *_ in rows}
    for r in got:
        text = texts[r.doc_id, r.base_sha256]
        base = plain(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(said(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r.n_added
    by_id = {r.doc_id: r for r in got}
    missed = dict((s.split(":")[0], rows[300][1][int(s.split(":")[1]):int(s.split(":")[2])]) for s in by_id[1000].spans.split(","))
    assert missed == {"phone": "+1 (269) 555-3296", "card": "4111111111111111"}
    repeated = by_id[1006].spans.split(",")
    assert [s.split(":")[0] for s in repeated] == ["phone", "phone"] and by_id[1006].n_added == 1
    assert by_id[1007].n_added == 0, "its digits fail their check"
    assert by_id[1005].n_added == by_id[1003].n_added == by_id[1001].n_added == by_id[1004].n_added == 0
    assert by_id[1001].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_document_is_labelled_alike_in_any_batch(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    key = lambda rows: sorted(map(str, rows))
    assert key(personal_data(docs.coalesce(1)).collect()) == key(personal_data(docs.repartition(7)).collect())


def test_no_rows(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_tokens_pull_each_other():
    """A token whose own features are undecided follows the base span that it repeats."""
    unary, skip = np.zeros((WIDTH, 5)), 4 * np.eye(5)
    features = np.zeros((3, 7), np.int64)
    keys = np.zeros((3, KEYS), np.int64)
    keys[[0, 2], 1] = 5
    edges = skip_edges(keys, np.zeros(3, np.int64))
    got = Field(unary, np.zeros((5, 5)), skip).marginals(features, np.array([4, -1, -1]), np.zeros((0, 2), np.int64), edges)
    assert got[2].argmax() == 4 and got[2, 4] > pd_.SURE and abs(got[1, 4] - 0.2) < 1e-9
