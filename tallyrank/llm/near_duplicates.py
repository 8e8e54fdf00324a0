"""Near-duplicate documents by circulant MinHash.

Two permutations make every signature coordinate: the first scatters the shingles
over a ring of 2**32 places, the second, turned by one more place for each
coordinate, orders them; a coordinate is the least place.  Bands of equal
coordinates propose pairs and the full shingle sets decide them.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrank.llm import words
from tallyrank.llm.components import components
from tallyrank.session import materialize

WIDTH = 5
BANDS, ROWS = 32, 4
#: Coordinates of a signature; four bits of each are its sketch, in four planes of bits.
COORDINATES = 256
#: The same of the finer sketches, of the sets that are held against others than hubs.
FINE = 1024
#: Members of a bucket that its other members are first held against.
HUBS = 1
#: Standard deviations above the mean of a sketch's differences at the least
#: similarity; about one link in a million is beyond.
SPREAD = 4.8
_FIRST = np.uint64(0x5851F42D4C957F2D)


def _second(x: np.ndarray) -> np.ndarray:
    """The turned permutation, a bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """The circulant MinHash coordinates of a set of 64-bit shingles."""
    places = (words.mix(shingles ^ _FIRST) >> np.uint64(32)).astype(np.uint32)
    turns = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 1024):  # blocks that stay in the cache
        np.minimum(least, _second(places[None, i:i + 1024] + turns).min(axis=1), out=least)
    return least


def sketched(signature: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, in planes."""
    planes = [np.packbits((signature >> np.uint32(p) & np.uint32(1)).astype(np.uint8)) for p in range(4)]
    return np.concatenate(planes).view(np.int64)


def _finer(batches):
    for batch in batches:
        found = [sketched(signature(np.frombuffer(x.as_buffer(), np.uint64), FINE)) for x in batch.column("shingles")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "sketch"])


def _signed(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            ids, sizes, classes, keys, sketches = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                s = words.shingles(text.as_py(), width)
                sig = signature(s)
                band = np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    band = words.mix(band + (sig[r:bands * rows:rows].astype(np.uint64) << np.uint64(8)) + np.uint64(r))
                ids.append(doc)
                sizes.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band.view(np.int64))
                sketches.append(sketched(sig))
            if ids:
                def lists(of):
                    ends = np.arange(len(of) + 1, dtype=np.int32) * len(of[0])
                    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(of)))

                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()),
                    lists(keys), lists(sketches),
                ], ["doc_id", "n_shingles", "class", "bands", "sketch"])

    return run


def signed(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: set size, 128-bit name of its set, band keys, sketch."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signed(width, bands, rows),
        "doc_id long, n_shingles long, class binary, bands array<long>, sketch array<long>")


def _sets(width: int):
    def run(batches):
        for batch in batches:
            nodes, found = [], []
            for node, name, text in zip(batch.column("node").to_pylist(), batch.column("class").to_pylist(),
                                        batch.column("text")):
                s = words.shingles(text.as_py(), width)
                if xxhash.xxh3_128_digest(s.tobytes()) == name:
                    nodes.append(node)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())],
                                             ["node", "shingles"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            yes = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(yes))

    return run


def _alike(a: str, b: str, percent: int, coordinates: int = COORDINATES):
    """Pairs that can still reach the similarity, by what they may share and by sketches.

    ``most`` of a side is an upper bound of what it has in common with any other set.
    Four bits of a coordinate differ for 15 of 16 unequal coordinates.
    """
    q = (1 - percent / 100) * 15 / 16
    most = int(coordinates * q + SPREAD * math.sqrt(coordinates * q * (1 - q)))
    words_of_plane = coordinates // 64
    apart = F.lit(0)
    for w in range(words_of_plane):
        unequal = [F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])
                   for i in range(w, 4 * words_of_plane, words_of_plane)]
        apart = apart + F.bit_count(functools.reduce(lambda x, y: x.bitwiseOR(y), unequal))
    both = F.least(f"{a}.most", f"{b}.most")
    reach = both * (100 + percent) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    return reach & (apart <= most)


class _Checker:
    """Decides pairs of nodes on the full sets of the nodes' texts, computed once for each."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.nodes, self.width, self.percent = nodes, width, percent

    def sets(self, wanted: DataFrame) -> DataFrame:
        wanted = self.nodes.select("node", "doc_id", "class").join(wanted.distinct(), "node")
        held = self.texts.join(wanted, self.texts["doc_id"].eqNullSafe(wanted["doc_id"]))
        held = held.select("node", "class", "text").mapInArrow(_sets(self.width), "node long, shingles binary")
        # A document met in several equal rows is taken once.
        return materialize(held.dropDuplicates(["node"]) if self.repeated() else held, "shingles")

    def links(self, pairs: DataFrame, held: DataFrame | None = None) -> DataFrame:
        if held is None:
            held = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        left = held.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
        right = held.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
        # The hub of many pairs first, on bare pairs; then the sets travel by the other side.
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
        return materialize(both.mapInArrow(_confirmed(self.percent), "a long, b long"), "links")

    def repeated(self) -> bool:
        """Whether any doc_id comes twice, so that one node may find two texts."""
        if not hasattr(self, "_repeated"):
            ids = self.texts.groupBy("doc_id").count().where("count > 1")
            self._repeated = bool(ids.take(1))
        return self._repeated


def _listed(batches):
    for batch in batches:
        nodes, sets = batch.column("node").to_numpy(), [x.as_buffer() for x in batch.column("shingles")]
        for i in range(0, len(sets), 256):
            part = [np.frombuffer(x, np.int64) for x in sets[i:i + 256]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(nodes[i:i + 256], [len(x) for x in part])), pa.array(np.concatenate(part))],
                ["node", "shingle"])


def _across(shared: DataFrame, named: DataFrame, sizes: DataFrame, checker: _Checker) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components in a bucket, but for two of its largest one, and their sets."""
    member = shared.select("key", "node").join(named, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component"))
    member = materialize(member, "members")
    counts = member.groupBy("key", "component").count()
    main = counts.groupBy("key").agg(F.max(F.struct("count", "component")).alias("top"),
                                     F.count("*").alias("parts")).where("parts > 1")
    rest = materialize(member.join(main.select("key", F.col("top.component").alias("main")), "key"), "apart")
    # A shingle that no other of these sets has can't be in common.
    held = checker.sets(rest.select("node"))
    own = held.mapInArrow(_listed, "node long, shingle long").groupBy("shingle").agg(
        F.min("node").alias("node"), F.count("*").alias("sets")).where("sets = 1")
    own = own.groupBy("node").agg(F.count("*").alias("own"))
    bound = sizes.join(own, "node", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
    bound = bound.where(100 * F.col("most") >= checker.percent * F.col("n"))
    # Few sets are left, so a finer sketch of each is cheap.
    fine = held.join(bound.select("node"), "node", "left_semi").mapInArrow(_finer, "node long, sketch array<long>")
    # A pair is taken in the first of the buckets it meets in.
    own = rest.groupBy("node").agg(F.collect_list("key").alias("keys"))
    bound = materialize(bound.join(fine, "node").join(own, "node"), "finer")
    rest = rest.join(bound, "node")
    odd, rest = rest.where("component <> main").alias("x"), rest.alias("y")
    cross = odd.join(rest, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
                     & _alike("x", "y", checker.percent, FINE)
                     & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")))
    return cross.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), held


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = 75, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class`` for every row of ``docs``.

    Rows are linked when their sets of distinct ``width``-word shingles share
    ``percent`` of their union; a component is closed under links and named by its
    smallest ``doc_id``.  Equal sets are one node, so copies cost one row each.
    A null or empty text, or one without words, has no shingles and stands alone.
    A null ``doc_id`` takes part; a component of nothing else has a null name and
    its rows are kept.  Other columns of ``docs`` play no part; no rows give none.

    Of buckets of equal band keys with the same members one is kept.  Each first holds
    its members against its most central one (that shares most buckets with others), so
    a bucket of any size costs its size.  Only members that are then still in another component than most
    of their bucket are held against the rest of it, unless the shingles that they share
    with any set there are too few or finer sketches tell them apart, so but for one in a
    million no link that a band proposes is lost.  With 32 bands of 4 rows, a pair at the
    least similarity goes unproposed five times in a million.
    """
    signs = materialize(signed(docs, width, bands, rows), "signatures")
    one = signs.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"))
    nodes = materialize(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
    checker = _Checker(docs, nodes, width, percent)

    keyed = nodes.select("node", F.explode("bands").alias("key"))
    # Buckets of the same members propose the same pairs: one of them is enough.
    print_ = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"print_{i}") for i in (1, 2)]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), *print_).where("size > 1")
    sizes = sizes.groupBy("size", "print_1", "print_2").agg(F.min("key").alias("key")).select("key", "size")
    shared = materialize(keyed.join(sizes, "key"), "buckets")
    sketch = nodes.select("node", "n", "sketch")

    central = shared.groupBy("node").agg(F.sum("size").alias("met"))
    order = Window.partitionBy("key").orderBy(F.desc("met"), "node")
    hubs = shared.join(central, "node").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS)
    hubs = hubs.select("key", F.col("node").alias("hub"))
    stars = shared.select("key", "node").join(hubs, "key").where("node <> hub")
    stars = stars.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    x = sketch.select(F.col("node").alias("a"), F.struct("n", F.col("n").alias("most"), "sketch").alias("x"))
    y = sketch.select(F.col("node").alias("b"), F.struct("n", F.col("n").alias("most"), "sketch").alias("y"))
    stars = stars.join(x, "a").join(y, "b").where(_alike("x", "y", percent)).select("a", "b")
    stars = materialize(stars, "stars")
    links = checker.links(stars)

    cross, held = _across(shared, components(links), nodes.select("node", "n"), checker)
    cross = materialize(cross.join(stars, ["a", "b"], "left_anti"), "cross")
    links = links.union(checker.links(cross, held))

    named = components(links)
    nodes = nodes.join(named, "node", "left").select("class", "doc_id", F.coalesce("component", "node").alias("c"))
    names = nodes.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    nodes = nodes.join(names, "c").select("class", "component_id")
    out = signs.select("doc_id", "n_shingles", "class").join(nodes, "class", "left")
    # Sets without shingles match no node.
    name = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"),
                      "class")


def distinct_documents(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates, that of its smallest ``doc_id``.

    Of rows that share a ``doc_id`` the one with the smallest text stays.  Rows without
    ``doc_id`` can't be named and stay; so do texts without words, each once per id.
    """
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    place = "_place"
    while place in docs.columns:
        place += "_"
    named = named.withColumn(place, first).where(F.col(place) == 1).drop(place)
    return named.select(docs.columns).union(docs.where("doc_id is null"))
