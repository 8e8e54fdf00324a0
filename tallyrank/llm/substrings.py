"""Repeated passages across documents, found from fixed-block anchors.

Every document is indexed by its non-overlapping blocks of words and probed with all
its rolling windows of that length.  A passage of at least twice a block less one
word holds a whole block, so every repeat shows as a hit.  Hits are extended to the
maximal exact repeats by comparing the passages of full length around them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyrank.llm import words
from tallyrank.session import materialize

WINDOW = 50
#: Words of one pre-aggregated slice of documents.
SLICE_WORDS = 200_000
#: Texts whose beginnings the packing of texts starts from.
SHARED_TEXTS = 64
_PACKED = "bucket int, docs binary, counts binary, places binary, hashes binary"
_FOUND = "doc_id long, found binary"
_SHAPE = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_CANDIDATES = "kind int, bucket int, doc_id long, n_words long, kept_sha256 string, docs binary, counts binary, hashes binary"


def block_words(window: int) -> int:
    """The longest block of which every passage of ``window`` words holds a whole one."""
    return (window + 1) // 2


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and the number of the group of each sorted key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.cumsum(new) - 1


def _rows(schema: str, own: pa.DataType | None = None, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in map(str.split, schema.split(", "))]
    fields += [("carried", own)] if own else []
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns.get(name, [None] * n), kind) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _carried(batch: pa.RecordBatch) -> tuple[list, pa.DataType | None]:
    """What each row carries along, and its type; without such a column nothing."""
    if "carried" not in batch.schema.names:
        return [None] * batch.num_rows, None
    return list(batch.column("carried")), batch.schema.field("carried").type


def _planes(values: np.ndarray) -> bytes:
    """Differences of whole numbers, byte by byte, so that what shuffles can be compressed."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return d.view(np.uint8).reshape(-1, d.dtype.itemsize).T.tobytes()


def _whole_numbers(planes: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    d = np.frombuffer(planes, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()
    return np.cumsum(d, dtype=kind)


def _packed(bucket: np.ndarray, doc: np.ndarray, ids: np.ndarray, **values) -> list[dict]:
    """One row for each bucket: its documents, how many entries each has, and the entries."""
    order = np.lexsort((doc, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    out = []
    for part in np.split(order, cuts):
        if len(part):
            present, counts = np.unique(doc[part], return_counts=True)
            out.append({"bucket": int(bucket[part[0]]), "docs": _planes(ids[present]),
                        "counts": _planes(counts.astype(np.uint32)),
                        **{k: _planes(v[part]) if k == "places" else v[part].tobytes() for k, v in values.items()}})
    return out


def _sliced(batches, columns: list[str]):
    """Lists of rows of about ``SLICE_WORDS`` words, what they carry last, and its type."""
    held, size, kind = [], 0, None
    for batch in batches:
        carried, kind = _carried(batch)
        for row in zip(*(batch.column(c).to_pylist() for c in columns), carried):
            held.append(row)
            size += 1 + len(row[1] or "") // 6
            if size >= SLICE_WORDS:
                yield held, kind
                held, size = [], 0
    if held:
        yield held, kind


def _probes(block: int, bits: int):
    def run(batches):
        for rows, _ in _sliced(batches, ["doc_id", "text"]):
            ids = np.array([r[0] for r in rows], np.int64)
            found = [words.windows(words.prefix_sums(words.hashes(words.split(t))), block) for _, t, _ in rows]
            sizes = [len(x) for x in found]
            h = np.concatenate(found)
            if not len(h):
                continue
            doc = np.repeat(np.arange(len(ids)), sizes)
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
            indexed = place % block == 0
            # What is a hit within the slice goes no further, but for one block to tell others of it.
            order, group = _groups(h)
            count = np.bincount(group)
            blocks = np.bincount(group, weights=indexed[order]).astype(np.int64)
            sure = (count > 1) & (blocks > 0)
            first = np.full(len(count), len(h))
            np.minimum.at(first, group[indexed[order]], order[indexed[order]])
            hit, send = np.zeros(len(h), bool), np.zeros(len(h), bool)
            hit[order] = sure[group]
            send[order] = ~sure[group]
            send[first[sure]] = True
            bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
            rest = (h >> np.uint64(32 - bits)).astype(np.uint32)
            out = _packed(bucket[send], doc[send], ids, places=place[send], hashes=rest[send])
            if hit.any():
                own = np.full(int(hit.sum()), -1 - int(h[0] % np.uint64(1 << bits)), np.int32)
                out += _packed(own, doc[hit], ids, places=place[hit])
            yield _rows(_PACKED, **{k: [r.get(k, b"") for r in out]
                                    for k in ("bucket", "docs", "counts", "places", "hashes")})

    return run


def _unpacked(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    read = {"docs": np.int64, "counts": np.uint32, "places": np.uint32}

    def column(c: str, t) -> np.ndarray:
        parts = table.column(c).to_pylist()
        if c in read:
            return np.concatenate([_whole_numbers(x, t) for x in parts])
        return np.frombuffer(b"".join(parts), t)

    return np.repeat(column("docs", np.int64), column("counts", np.uint32)), column(name, kind)


def _by_doc(doc: np.ndarray, values: np.ndarray) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    starts = np.concatenate([[0], cuts]).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    return pa.Table.from_batches([_rows(_FOUND, doc_id=doc[starts],
                                        found=[x.tobytes() for x in np.split(values, cuts) if len(x)])])


def _hits(block: int):
    def run(table: pa.Table) -> pa.Table:
        doc, place = _unpacked(table, "places", np.uint32)
        if table.column("bucket")[0].as_py() >= 0:
            rest = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint32)
            order, group = _groups(rest)
            indexed = place[order] % block == 0
            hit = (np.bincount(group) > 1) & (np.bincount(group, weights=indexed) > 0)
            order = order[hit[group]]
            doc, place = doc[order], place[order]
        return _by_doc(doc, place)

    return run


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _codec(shared: bytes):
    """Packing and unpacking of texts that have ``shared`` in common; results don't depend on it."""
    common = zstandard.ZstdCompressionDict(shared, zstandard.DICT_TYPE_RAWCONTENT) if shared else None
    return (zstandard.ZstdCompressor(6, dict_data=common).compress, zstandard.ZstdDecompressor(common).decompress)


def _candidates(window: int, block: int, bits: int, shared: bytes):
    """Documents without hits as they are; of the others the text and the passages around hits.

    The texts of all go on where rows carry something along.
    """

    def run(batches):
        _, unpack = _codec(shared)
        for rows, kind in _sliced(batches, ["doc_id", "text", "hits"]):
            done, held, found, owner = [], [], [], []
            for doc_id, packed, hits, carried in rows:
                ws = unpack(packed).split() if packed else []
                n = len(ws)
                near = np.zeros(0, np.int64)
                if hits and n >= window:
                    at = np.frombuffer(b"".join(hits), np.uint32)
                    marks = np.zeros(n - block + 2, np.int64)
                    marks[1 + at[at < len(marks) - 1]] = 1
                    seen = np.cumsum(marks)
                    reach = window - block + 1
                    near = np.flatnonzero(seen[reach:] > seen[:-reach])[:n - window + 1]
                if len(near):
                    h = words.windows(words.prefix_sums(words.hashes(ws)), window)[near]
                    h = np.unique(h)
                    owner.append(np.full(len(h), len(held)))
                    found.append(h)
                    held.append((doc_id, n, packed, carried))
                else:
                    done.append((doc_id, n, packed if kind else None, carried, _digest(ws)))
            if done:
                yield _rows(_CANDIDATES, kind, kind=[0] * len(done), doc_id=[r[0] for r in done],
                            n_words=[r[1] for r in done], docs=[r[2] for r in done],
                            carried=[r[3] for r in done], kept_sha256=[r[4] for r in done])
            if not held:
                continue
            ids = np.array([r[0] for r in held], np.int64)
            h, doc = np.concatenate(found), np.concatenate(owner)
            # The smallest document of the slice speaks for it; larger ones lose the passage at once.
            order = np.lexsort((ids[doc], h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            least = ids[doc[new]][np.cumsum(new) - 1]
            lost = ids[doc] > least
            gone = [h[lost & (doc == i)].tobytes() for i in range(len(held))] if lost.any() else [b""] * len(held)
            yield _rows(_CANDIDATES, kind, kind=[2] * len(held), doc_id=[r[0] for r in held],
                        n_words=[r[1] for r in held], docs=[r[2] for r in held],
                        carried=[r[3] for r in held], hashes=gone)
            out = _packed((h[new] >> np.uint64(64 - bits)).astype(np.int32), doc[new], ids, hashes=h[new])
            yield _rows(_CANDIDATES, kind, kind=[1] * len(out), **{k: [r[k] for r in out]
                                                                   for k in ("bucket", "docs", "counts", "hashes")})

    return run


def _lost(table: pa.Table) -> pa.Table:
    doc, h = _unpacked(table, "hashes", np.uint64)
    order, group = _groups(h)
    doc, h = doc[order], h[order]
    least = np.full(group[-1] + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc)
    gone = doc > least[group]
    return _by_doc(doc[gone], h[gone])


def _kept(window: int, shared: bytes):
    def run(batches):
        _, unpack = _codec(shared)
        for batch in batches:
            out, (carried, kind) = [], _carried(batch)
            for doc_id, packed, own, others in zip(*(batch.column(c).to_pylist()
                                                     for c in ("doc_id", "docs", "hashes", "others"))):
                text = unpack(packed)
                ws = text.split()
                h = words.windows(words.prefix_sums(words.hashes(ws)), window)
                gone = np.isin(h, np.frombuffer(own + b"".join(others or []), np.uint64))
                edge = np.zeros(len(ws) + 1, np.int64)
                edge[:len(h)] += gone
                edge[window:window + len(h)] -= gone
                cover = np.cumsum(edge)[:-1] > 0
                kept = [w for w, c in zip(ws, cover) if not c]
                left = b" ".join(kept)
                digest = hashlib.sha256(left).hexdigest()
                if len(kept) == len(ws):
                    left = text if kind else None
                out.append((doc_id, len(ws), len(ws) - len(kept), digest, None if left is None else left.decode()))
            columns = zip(*out) if out else [[]] * 5
            yield _rows(_SHAPE, kind, carried=carried, **dict(zip(
                ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"), columns)))

    return run


def _same(shared: bytes):
    """Documents that lose nothing, with their texts unpacked."""

    def run(batches):
        _, unpack = _codec(shared)
        for batch in batches:
            carried, kind = _carried(batch)
            texts = [None if t is None else unpack(t).decode() for t in batch.column("docs").to_pylist()]
            known = {c: batch.column(c).to_pylist() for c in ("doc_id", "n_words", "kept_sha256")}
            yield _rows(_SHAPE, kind, **known, n_removed=[0] * len(texts), kept_text=texts, carried=carried)

    return run


def _compressed(shared: bytes):
    def run(batches):
        pack, _ = _codec(shared)
        for batch in batches:
            texts = [None if t is None else pack(t.encode()) for t in batch.column("text").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()))

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, carried: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` for every row of ``docs``.

    Every word goes that a run of ``window`` words covers which also starts in a
    document with a smaller ``doc_id``; runs are judged on the input.  Words are
    compared as they are.  ``kept_text`` is null where nothing goes: there the text
    stays as it was.  Null, empty and white-space texts have no words.  A row without
    ``doc_id`` is smaller than none and loses nothing; rows of one ``doc_id`` take
    nothing from one another.  Other columns play no part; no rows give none.

    With ``carried``, names of columns, each row brings these of its own along in a
    struct ``carried``, and ``kept_text`` is its text also where nothing goes; so rows
    need not be joined with ``docs`` again, which would shuffle all texts once more.

    Windows travel in blocks of bounded size, dealt by hash, and a passage that many
    documents of a slice share leaves the slice once.  Hashes have 64 bits.
    """
    spark = docs.sparkSession
    block = block_words(window)
    bits = max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    bits = min(bits, 20)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                        *([F.struct(*carried).alias("carried")] if carried else []))
    named = texts.where("doc_id is not null")
    own = ["carried"] if carried else []

    def shape(ddl: str) -> StructType:
        out = StructType.fromDDL(ddl)
        return out.add("carried", texts.schema["carried"].dataType) if carried else out

    probes = named.select("doc_id", "text").mapInArrow(_probes(block, bits), _PACKED)
    hits = probes.groupBy("bucket").applyInArrow(_hits(block), _FOUND)
    hits = hits.groupBy("doc_id").agg(F.collect_list("found").alias("hits"))
    # Texts travel packed, by what a few of them hold.
    few = named.where("text is not null").select(F.substring("text", 1, 2_000)).limit(SHARED_TEXTS).collect()
    shared = "\n".join(r[0] for r in few).encode()
    packed = named.mapInArrow(_compressed(shared), shape("doc_id long, text binary")).join(hits, "doc_id", "left")
    split = materialize(packed.mapInArrow(_candidates(window, block, bits, shared), shape(_CANDIDATES)), "passages")

    lost = split.where("kind = 1").select("bucket", "docs", "counts", "hashes")
    lost = lost.groupBy("bucket").applyInArrow(_lost, _FOUND)
    lost = lost.groupBy("doc_id").agg(F.collect_list("found").alias("others"))
    held = split.where("kind = 2").select("doc_id", "docs", "hashes", *own).join(lost, "doc_id", "left")
    held = held.mapInArrow(_kept(window, shared), shape(_SHAPE))
    same = split.where("kind = 0").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256",
        F.lit(None).cast("string").alias("kept_text"), "docs", *own)
    same = same.mapInArrow(_same(shared), shape(_SHAPE)) if carried else same.drop("docs")
    nameless = texts.where("doc_id is null").mapInArrow(_whole, shape(_SHAPE))
    return same.unionByName(held).union(nameless)


def _whole(batches):
    for batch in batches:
        carried, kind = _carried(batch)
        texts = batch.column("text").to_pylist()
        ws = [words.split(t) for t in texts]
        yield _rows(_SHAPE, kind, n_words=[len(w) for w in ws], n_removed=[0] * len(ws),
                    kept_sha256=[_digest(w) for w in ws], kept_text=texts if kind else [None] * len(ws), carried=carried)
