"""Document fingerprints by locally consistent parsing.

A text is parsed level by level.  Runs of one symbol become a symbol; deterministic
coin tossing turns the symbols into labels below six, of which neighbours differ;
a phrase begins at every local maximum, and a phrase's name is the hash of its
symbols.  Where a phrase begins depends on a few symbols around it alone, so equal
substrings are parsed alike but for their ends, wherever they stand.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrank.llm import words
from tallyrank.llm.near_duplicates import signature

#: Levels whose phrase names make a fingerprint: phrases of some 30 and 90 characters.
LEVELS = (3, 4)
COORDINATES = 64
#: Characters parsed together.
SLICE = 200_000
TOSSES = 4


def _toss(labels: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a label differs from the one before, plus that bit."""
    other = np.empty_like(labels)
    other[0] = 0
    other[1:] = labels[:-1]
    differ = labels ^ other
    low = differ & (~differ + differ.dtype.type(1))
    bit = np.bitwise_count(low - differ.dtype.type(1))
    bit[differ == 0] = 0
    return (2 * bit + ((labels & low) != 0)).astype(np.uint8)


def _level(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of one level: their names and documents."""
    new = np.ones(len(symbols), bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(symbols)))
    symbols, doc = symbols[starts], doc[starts]
    names = symbols.astype(np.uint64)
    long = runs > 1
    names[long] = words.mix(names[long] * np.uint64(words.BASE) + runs[long].astype(np.uint64))
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    labels = names
    for _ in range(TOSSES):
        labels = _toss(labels)
        # A text's first symbol has nothing before it, so what stands before the text plays no part.
        labels[first] = 0
    before, after = np.empty_like(labels), np.empty_like(labels)
    before[1:], before[0] = labels[:-1], 0
    after[:-1], after[-1] = labels[1:], 0
    last = np.append(first[1:], True)
    after[last] = 0
    begins = np.flatnonzero(first | ((labels > before) & (labels > after)))
    sums = words.prefix_sums(words.mix(names + np.uint64(1)))
    ends = np.append(begins[1:], len(names))
    inverse = words.powers(len(names) + 1)[1]
    return words.mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)), doc[begins]


def phrase_names(texts: list[str], levels: tuple[int, ...] = LEVELS) -> list[np.ndarray]:
    """The distinct phrase names of each text on the given levels; none for an empty one."""
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in codes])
    symbols = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    names, owners = [], []
    for level in range(1, max(levels) + 1):
        if not len(symbols):
            break
        symbols, doc = _level(symbols, doc)
        if level in levels:
            names.append(symbols)
            owners.append(doc)
    if not names:
        return [np.zeros(0, np.uint64) for _ in texts]
    owner, name = np.concatenate(owners), np.concatenate(names)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(texts)))
    return [np.unique(x) for x in np.split(name[order], cuts)]


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint of each text: 16 bits of each least of its phrase names, in hex; empty for an empty text."""
    return [(signature(x, COORDINATES) & np.uint32(0xFFFF)).astype(">u2").tobytes().hex() if len(x) else ""
            for x in phrase_names(texts)]


def likeness(a: str, b: str) -> float:
    """The share of equal places of two fingerprints; 1 for two empty ones, 0 for one."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(v), np.uint16) for v in (a, b))
    return float((x == y).mean())


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row's whole text; null is empty, repeated rows are alike."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [f for part in _slices(texts) for f in fingerprints(part)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint string")


def _slices(texts: list[str]):
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + 1
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _dealt(bounds: np.ndarray, firsts: dict[int, int]):
    """Deals documents to ranges, and the first document of a range also to the range before."""

    def run(batches):
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                place = doc_id if doc_id is not None else -(1 << 63)
                data = pack((text or "").encode())
                rows.append((int(np.searchsorted(bounds, place, "right")), 0, place, doc_id, data))
                if place in firsts:
                    rows.append((firsts[place], 1, place, doc_id, data))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["range", "borrowed", "place", "doc_id", "data"])

    return run


def _pairs(batches):
    """Every document with the text of the next one, in order; ranges come one after another."""
    unpack = zstandard.ZstdDecompressor().decompress
    held = None
    for batch in batches:
        for number, borrowed, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("range", "borrowed", "doc_id", "data"))):
            if held is not None and held[0] != number:
                held = None
            if borrowed and held is None:
                continue
            text = unpack(data).decode()
            if held is not None:
                yield held[1], held[2], text
            held = None if borrowed else (number, doc_id, text)


def _compared(batches):
    def done(rows):
        texts = [r[1] for r in rows]
        lead = [r[2] for r in rows]
        edited = []
        for t, n in zip(texts, lead):
            half = len(t) // 2
            edited.append(t[:len(t) - half] + n[:half])
        # The next text is mostly the next row's, which is parsed anyway.
        other = [i for i in range(len(rows)) if i + 1 == len(rows) or texts[i + 1] != lead[i]]
        found = fingerprints(texts + edited + [lead[i] for i in other])
        own, new, rest = found[:len(rows)], found[len(rows):2 * len(rows)], dict(zip(other, found[2 * len(rows):]))
        after = [rest[i] if i in rest else own[i + 1] for i in range(len(rows))]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                   pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(own), pa.array(new),
                   pa.array([likeness(a, b) for a, b in zip(own, new)]), pa.array([likeness(a, b) for a, b in zip(own, after)])]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCHEMA.split(", ")])

    held, size = [], 0
    for row in _pairs(batches):
        held.append(row)
        size += len(row[1]) + 1
        if size >= SLICE // 2:
            yield done(held)
            held, size = [], 0
    if held:
        yield done(held)


def _ranges(bounds: np.ndarray):
    def run(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            number, least = np.unique(np.searchsorted(bounds, place, "right"), return_inverse=True)
            first = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(first, least, place)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(first)], ["range", "first"])

    return run


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and how alike they are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  The edited text has the last half of the code points replaced by as
    many of the next document's first ones, by ascending ``doc_id`` (null first, ties by
    the texts' compressed bytes, the first after the last).  Null texts are empty; an only row follows itself;
    other columns play no part; no rows give none.

    Documents are dealt to ranges of ``doc_id`` of like size, found from quantiles, and a
    range also gets the first document after it, so texts travel once, compressed.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = texts.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = np.unique(np.array(cuts, np.int64))
    least = texts.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place")).mapInArrow(
        _ranges(bounds), "range int, first long").groupBy("range").agg(F.min("first").alias("first"))
    firsts = sorted((r["range"], r["first"]) for r in least.collect())  # one row per range
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    dealt = texts.mapInArrow(_dealt(bounds, before), "range int, borrowed int, place long, doc_id long, data binary")
    # The range before the first one is the last, whose borrowed document sorts behind its own.
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "borrowed", "place", "data")
    return dealt.mapInArrow(_compared, _SCHEMA)
