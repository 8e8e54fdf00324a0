"""Packing: exact ids, every token in one place, nothing padded."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyrank.llm import packing
from tallyrank.llm.packing import SumOfSquares, packed, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


WHOLE = Tokenizer.from_file(PATH)


def whole(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " \n\t", "Hello, World! it's 1234 don't", "İstanbul ẞ Straße ΣΑΣ ΑΣ", "été café Å", "a b c\x85d\x1ce\x0bf",
    "<|endoftext|>a <|startoftext|> x<|y", "日本語 テスト ñandú ça", "x" * 5000, "½ ² 5́ ...?! #$%*** ''s 'LL", "ǅ ŉ ſ Ā ź",
    "".join(map(chr, range(1, 0x250))),
])
def test_ids_are_the_tokenizers(text):
    assert tokenizer(PATH).ids(text).tolist() == whole(text)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_ids_of_many_texts_are_the_tokenizers(kind, monkeypatch):
    for bound, value in (("TOGETHER", 200), ("WRITTEN", 50), ("CACHED", 100)):
        monkeypatch.setattr(packing, bound, value)
    rng = random.Random(3)
    parts = ["a", "B", "the", " ", "\n", "\x0b", "\x1c", "\x85", "\xa0", ".", "'S", "1", "É", "e\u0301", "H\u0331", "İ", "Σ", "日本",
             "<|", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choices(parts[:rng.choice([4, 14, 21])], k=rng.choice([0, 1, 5, 40]))) for _ in range(500)]
    texts[::50] = [None] * 10
    ids = [i.tolist() for i in tokenizer(PATH).columns(pa.array(texts, kind))]
    assert ids == [whole(t or "") for t in texts]


def test_a_batch_looks_up_each_distinct_word_once(monkeypatch):
    class Counted(type(tokenizer(PATH))):
        asked = 0

        def __getitem__(self, piece):
            self.asked += piece != " "
            return super().__getitem__(piece)

    monkeypatch.setitem(packing._tokenizers, PATH, counted := Counted(PATH))
    texts = [f"Alpha beta gamma, w{i % 10}" for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": texts})
    rows = [r for out in packing._packed(PATH, 2048, 1)([batch]) for r in out.to_pylist()]
    assert sum(r["length"] for r in rows) == sum(len(whole(t)) + 1 for t in texts)
    assert counted.asked <= 3 + 1 + 2 * 10


def check(rows, docs, length):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = np.array([*whole(text or ""), 1], np.uint32)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens <= length
        assert at == length or at & (at - 1) == 0


def test_every_token_lies_in_one_piece_and_nothing_is_padded(spark):
    docs = {i: " ".join(f"w{j * i}" for j in range(i * 7 % 300)) for i in range(120)}
    docs |= {500: None, 501: "", 502: "long " * 5000}
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in docs.items()], "doc_id long, text string, offset string, start int")
    check(packed(frame.repartition(3), PATH, length=256).collect(), docs, 256)


def test_repeated_rows_null_ids_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = packed(frame.coalesce(1), PATH).collect()
    assert sum(r.length for r in rows) == 8 and {r.doc_id for r in rows} == {1, None}
    assert packed(frame.limit(0), PATH).collect() == []


def test_placement_leaves_the_least_sum_of_squares():
    rng, length = np.random.default_rng(1), 32
    levels = SumOfSquares(length)
    for size in rng.integers(1, length, 400).tolist():
        counts = levels.counts.copy()

        def after(level):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < length:
                c[level + size] += 1
            return int((c * c).sum())

        allowed = [h for h in range(length - size + 1) if h == 0 or counts[h]]
        best = min(map(after, allowed))
        level = levels.level(size)
        assert level in allowed and after(level) == best
        levels.place(size, lambda: 0)
        assert int((levels.counts ** 2).sum()) == best
