"""Repeated passages against a plain form."""

import hashlib
import random

import pytest

import tallyrank.llm.substrings as substrings
from tallyrank.llm.substrings import without_repeats

SCHEMA = "doc_id long, text string, found string, bucket int"


def plain(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        for s in range(len(ws) - window + 1):
            if i is not None:
                key = tuple(ws[s:s + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, ws in split:
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[s:s + window])] < i:
                gone[s:s + window] = [True] * window
        kept = [w for w, g in zip(ws, gone) if not g]
        out.append((i, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    passages = [[word() for _ in range(rng.randint(6, 30))] for _ in range(6)]
    docs = []
    for i in range(150):
        ws = [word() for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    odd = [(None, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l"),
           (2, None), (3, ""), (4, " \n"), (5, "A b c d e f g h i j k l"), (6, "x a b c d e f g h i j k l y"),
           (6, "x a b c d e f g h i j k l"), (7, "te " * 400), (8, "te " * 500), (9, "a b c")]
    hot = [(i, "p q r s t u v w x y z aa bb " + f"own{i} " * (i % 5)) for i in range(90)]
    return {"mixed": docs, "odd": odd, "hot": hot, "none": []}


@pytest.mark.parametrize("slice_words", [50, 200_000])
@pytest.mark.parametrize("name", list(cases()))
def test_equals_the_plain_form(spark, monkeypatch, name, slice_words):
    rows = cases()[name]
    monkeypatch.setattr(substrings, "SLICE_WORDS", slice_words)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = without_repeats(frame, window=10)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    assert sorted(got, key=str) == plain(rows, 10)


@pytest.mark.parametrize("slice_words", [50, 200_000])
def test_rows_carry_their_own_columns_and_whole_texts(spark, monkeypatch, slice_words):
    monkeypatch.setattr(substrings, "SLICE_WORDS", slice_words)
    rows = [(i, t, k) for k, (i, t) in enumerate(cases()["odd"] + cases()["mixed"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, place int")
    got = {r.carried.place: r for r in without_repeats(frame, window=10, carried=["place", "doc_id"]).collect()}
    assert sorted(got) == list(range(len(rows)))
    for i, t, k in rows:
        assert (got[k].doc_id, got[k].carried.doc_id) == (i, i)
        if got[k].n_removed == 0:
            assert got[k].kept_text == t
        else:
            assert hashlib.sha256(got[k].kept_text.encode()).hexdigest() == got[k].kept_sha256
    digests = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.values()]
    assert sorted(digests, key=str) == plain([r[:2] for r in rows], 10)
