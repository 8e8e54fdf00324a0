"""The other text operators against brute force, and on odd rows."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tallyrank.llm import chat
from tallyrank.llm.near_duplicates import distinct_documents, near_duplicates
from tallyrank.llm.neighbours import nearest
from tallyrank.llm.phrases import compared_with_edits, fingerprints, likeness, phrase_names
from tallyrank.llm.quality_model import describe, fit, quality
from tallyrank.llm.token_counts import PretokenTree, counter, token_counts, with_edits
from tallyrank.llm.toxicity import clause_matches, learn, toxicity

SCHEMA = "doc_id long, text string, class string, score int"
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(None, "a b c d e f", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (3, " \n", "x", 1), (4, "one two", "x", 1),
       (4, "one two", "x", 1), (5, "word " * 20000, "x", 1), (6, "ONE Two", "x", 1)]


def linked(rows):
    sets = []
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets.append({tuple(ws[j:j + 5]) for j in range(max(1, len(ws) - 4))} if ws else set())
    name = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * len(sets[x] | sets[y]):
                name = [name[y] if n == name[x] else n for n in name]
    least = {}
    for (i, _), n in zip(rows, name):
        least[n] = min([v for v in (least.get(n), i) if v is not None], default=None)
    return sorted(((i, len(s), least[n]) for (i, _), s, n in zip(rows, sets, name)), key=str)


def family(n):
    """Copies of one text with a few words changed: linked in chains, not all with all."""
    rng = random.Random(n)
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    rows = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(80)] = f"n{rng.randint(0, 9)}"
        rows.append((1000 - i, " ".join(ws)))
    return rows + [(i, f"own text number {i} " * (1 + i % 3)) for i in range(20)]


@pytest.mark.parametrize("rows", [family(70), [(r[0], r[1]) for r in ODD]])
def test_near_duplicates_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == linked(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    out = distinct_documents(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 2, 3, 4, 5, None]


def test_edited_trees_equal_whole_encodings():
    rng, count = random.Random(0), counter(BYTES)
    letters = " ab'ls\n\n  1é,.t\t"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        tree = PretokenTree(text, count)
        for _ in range(3):
            at, removed = rng.randint(0, len(text) + 2), rng.randint(0, rng.choice([2, 60]))
            added = "".join(rng.choice(letters) for _ in range(rng.randint(0, 8)))
            tree.edit(at, removed, added)
            at = min(at, len(text))
            text = text[:at] + added + text[at + removed:]
            assert tree.text() == text and tree.chars[1] == len(text)
            assert tree.tokens[1] == len(count.encoding.encode_ordinary(text))


def test_token_counts_on_odd_rows_and_an_edit_table(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    edits = spark.createDataFrame([(4, 1, 0, 3, "three"), (4, 2, 99, 5, "!"), (2, 1, 0, 0, "new"), (9, 1, 0, 0, "no")],
                                  "doc_id long, step int, at long, removed long, added string")
    got = {r.doc_id: r for r in token_counts(with_edits(docs, edits), BYTES).collect()}
    size = lambda t: len(counter(BYTES).encoding.encode_ordinary(t))
    assert got[4].n_tokens_edited == size("three two!") and got[2].n_tokens_edited == size("new")
    assert got[5].n_tokens == got[5].n_tokens_edited == size("word " * 20000) and got[1].n_tokens == 0
    assert token_counts(with_edits(docs.limit(0), edits), BYTES).collect() == []


def test_chat_windows_can_be_read_back(spark):
    rows = [(1, 0, "system", "be <kind> & terse"), *((1, i, ("user", "assistant")[i % 2], "w " * (i * 13 % 200)) for i in range(1, 60)),
            (2, None, None, None), (2, 1, "assistant", r"\### Assistant: </turn> ok &lt;"), (None, 0, "assistant", "x"),
            (3, 0, "a>b\n<", "</turn>\n<turn again user>\n"), (4, 0, "assistant", "long " * 3000), (5, 0, "user", "t"), (5, 0, "user", "t")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(turns, budget=300, history=60).collect()
    got = {r.conv_id: r for r in chat.read_back(chat.windows(turns, budget=300, history=60)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns == "".join(f"{r}\n{x}\n" for _, r, x in own)
        assert got[conv].loss == "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].formatted_chars == sum(len(w.text) for w in out if w.conv_id == conv)
    mine = [w for w in out if w.conv_id == 1]
    assert len(mine) > 5 and all(w.n_tokens <= 300 and w.text.count("be &lt;kind&gt; &amp; terse") == 1 for w in mine)
    assert chat.windows(turns.limit(0)).collect() == []


def test_toxicity_learns_words_and_reads_clauses(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randint(0, 60)}" for _ in range(30)) + (" you blorgish thing." if i % 5 == 0 else " fine."), "x", 1)
            for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 200)], "doc_id long, toxic int")
    model = learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(300))
    insults = {"idiot": 1.0}
    assert clause_matches("you idiot".split(), insults)[1] == 1 and clause_matches("idiot".split(), insults)[0] == 1
    assert clause_matches("you are not an idiot".split(), insults)[3] == 1
    assert clause_matches("she called him idiot".split(), insults)[4] == 1
    odd = toxicity(spark.createDataFrame(ODD, SCHEMA), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.3 and r["class"] == "x" for r in odd)
    assert learn(docs, labels.limit(0))[0] == {}


def test_long_toxic_texts_with_many_copies_leave_the_words_of_others(spark):
    rng = random.Random(4)
    clean = lambda what="fine": " ".join(f"w{rng.randint(0, 60)}" for _ in range(30)) + f" you {what} thing."
    rare = lambda: " ".join("".join(rng.choices("bcdfghklmnprst", k=9)) for _ in range(2500))
    copied, near = rare(), rare()
    toxic = [clean("blorgish") for _ in range(30)] + [copied] * 60 + [f"{near} n{i}" for i in range(60)]
    rows = [(i, t, "x", 1) for i, t in enumerate(toxic + [clean() for _ in range(300)])]
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i, *_ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    insults, weights = learn(docs, labels)
    assert "blorgish" in insults or "blorg*" in insults
    assert not set(copied.split()) & set(insults) and len(set(near.split()) & set(insults)) <= 3
    got = {r.doc_id: r.score for r in toxicity(docs, (insults, weights)).collect()}
    assert all(got[i] >= 0.3 for i in range(30)) and all(got[i] < 0.3 for i in range(150, 450))


def test_quality_from_positive_and_unlabelled(spark):
    rng = random.Random(2)
    good = lambda: " ".join(f"w{rng.randint(0, 900)}" for _ in range(60)) + "."
    rows = [(i, good() if i % 4 else "spam " * 60, "x", 1) for i in range(400)]
    described = describe(spark.createDataFrame(rows, SCHEMA))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality(described, fit(described, labels)).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 > 0) for i in range(200, 400)]) > 0.95
    odd = quality(describe(spark.createDataFrame(ODD, SCHEMA)), fit(described, labels.limit(0))).collect()
    assert len(odd) == len(ODD) and all(r.score == 0.5 for r in odd)


def test_neighbours_reach_the_recall_and_skip_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).round(3)
    x[40:60] = x[0]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(700, None, 1.0), (720, [0.0] * 16, 1.0), (740, [None] * 16, 1.0), (760, [float("nan")] * 16, 1.0), (780, [1.0], 1.0),
             (None, x[0].tolist(), 1.0), (800, [], 1.0)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), k=20).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, own in found.items():
        s = x @ x[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        hits += len(set(best) & {i for i, _ in own})
        assert len(own) == 20 and all(abs(s[i] - v) < 1e-9 for i, v in own)
    assert hits >= 0.9 * 20 * len(found)
    assert {i for i, _ in found[0]} == set(range(40, 60)) and [i for i, _ in found[0]] == list(range(40, 60))


def test_equal_substrings_share_phrases_wherever_they_stand():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    middle = text(3000)
    a, b = phrase_names([text(777) + middle, text(50) + middle + text(9)])
    inner, = phrase_names([middle])
    assert len(np.intersect1d(inner, a)) > 0.9 * len(inner) and len(np.intersect1d(inner, b)) > 0.9 * len(inner)
    assert fingerprints([middle, "", "x", middle])[0::3] == fingerprints([middle, middle])
    assert likeness("", "") == 1.0 and likeness("", fingerprints(["x"])[0]) == 0.0


@pytest.mark.parametrize("rows", [[(r[0], r[1]) for r in ODD], [(7, "only one")], []])
def test_texts_are_held_against_their_edits(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = compared_with_edits(docs).collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t in rows))
    expected = []
    for n, (i, t) in enumerate(order):
        half, following = len(t) // 2, order[(n + 1) % len(order)][1]
        edited = t[:len(t) - half] + following[:half]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *fingerprints([t, edited])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)
                  for r in got) == sorted(expected)
