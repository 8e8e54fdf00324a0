"""Packing of tokenized documents into sequences by sum-of-squares placement.

Each task reads its documents in order.  What fills whole sequences is cut off; the
rest is placed online: of all fill levels it fits on, the one whose use leaves the
least sum of squared counts of partly filled sequences, kept in an array by level.
Sequences still open at the end of a task are poured together.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

LENGTH = 2048
#: Pieces remembered by a process, and letters of one: some 100 MB.
CACHED, CACHED_LETTERS = 600_000, 32
#: Bytes of text whose words are told apart at once (one text at least), and tokens written out at once.
TOGETHER, WRITTEN = 8 << 20, 1 << 20
#: Up to this code point, Python lower-cases letters as the tokenizer does, and none compose.
PLAIN = 0x17F
_tokenizers: dict[str, "CachedIds"] = {}


def _shown(byte: int) -> int:
    """The character that stands for a byte in a byte-level vocabulary: itself if it can be seen."""
    if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
        return byte
    return 256 + (byte if byte < 33 else byte - 94 if byte < 161 else 67)


def _of(category: str) -> str:
    """The plain characters of a category, for a pattern."""
    return "".join(re.escape(c) for c in map(chr, range(PLAIN + 1)) if unicodedata.category(c)[0] == category)


SHOWN = {byte: _shown(byte) for byte in range(256)}
#: Fixed value: the pieces of a plain word that the vocabulary's tokenizer encodes by themselves; and blanks.
PIECES = re.compile(rf"[{_of('L')}]+|[{_of('N')}]| |'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_of('L')}{_of('N')}]+")
#: Rare letters and control strings, which are left to the whole tokenizer; for Python and for Arrow.
ODD, ODD_ROW = re.compile(r"[^\x00-\u017f]|<\|"), r"[^\x00-\x{17f}]|<\|"
#: Stands in for an id between words.
BLANK = np.uint32(0xFFFFFFFF)


def distinct_words(texts: pa.Array) -> tuple[str, bool, np.ndarray, np.ndarray]:
    """The distinct words joined by blanks, if any may be odd, which of them come one after the other, and each text's end there.

    A text has one word at least, which may be empty.
    """
    # Taken anew, as Arrow's lower-casing misreads strings that don't begin where their buffer does.
    texts = pc.fill_null(texts.cast(pa.string()), "").take(pa.array(np.arange(len(texts))))
    odd = pc.match_substring_regex(texts, ODD_ROW)
    # An odd text keeps its capitals: they tell control strings, and decide what composes.
    words = pc.ascii_split_whitespace(pc.if_else(odd, texts, pc.ascii_lower(texts)))
    ends = np.cumsum(pc.list_value_length(words).to_numpy())
    words = words.flatten().dictionary_encode()
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")
    return joined[0].as_py(), pc.any(odd).as_py(), words.indices.to_numpy(), ends


class CachedIds(dict):
    """Ids of pieces of words as bytes, remembered for pieces met before."""

    def __init__(self, path: str):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        """Ids of a lower-case piece, by the vocabulary's merges alone, or of an odd word."""
        if piece.isascii() and piece.isalpha():
            ids = array("I", [t.id for t in self.model(piece)]).tobytes()
        elif piece == " ":
            ids = BLANK.tobytes()
        elif ODD.search(piece):
            ids = array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        else:
            shown = piece.encode().decode("latin-1").translate(SHOWN)
            ids = array("I", [t.id for t in self.model(shown)]).tobytes()
        if len(piece) <= CACHED_LETTERS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids

    def words(self, joined: str, odd: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, and where those of each begin and how many they are; ``odd``: some may be."""
        apart, whole = [], []
        if odd:
            words = joined.split(" ")
            apart = [i for i, w in enumerate(words) if ODD.search(w)]
            whole = [self[words[i]] for i in apart]
            for i in apart:
                words[i] = ""
            joined = " ".join(words)
        pieces = PIECES.findall(joined.lower() + " ")
        flat = np.frombuffer(b"".join([*map(self.__getitem__, pieces), *whole]), np.uint32)
        blanks = np.flatnonzero(flat == BLANK)
        starts = np.append(0, blanks[:-1] + 1)
        sizes = blanks - starts
        if apart:
            sizes[apart] = [len(ids) // 4 for ids in whole]
            starts[apart] = blanks[-1] + 1 + np.cumsum(sizes[apart]) - sizes[apart]
        return flat, starts, sizes

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; white space parts it, and never joins what it parts."""
        joined, odd, which, ends = distinct_words(texts)
        flat, starts, sizes = self.words(joined, odd)
        tokens = np.cumsum(np.add.reduceat(sizes[which], np.append(0, ends[:-1])))
        first = 0
        while first < len(ends):
            # As many texts as have some WRITTEN tokens together.
            last = max(first + 1, int(np.searchsorted(tokens, (tokens[first - 1] if first else 0) + WRITTEN)))
            begin = ends[first - 1] if first else 0
            part = which[begin:ends[last - 1]]
            n = sizes[part]
            done = np.cumsum(n)
            ids = flat[np.repeat(starts[part] - done + n, n) + np.arange(done[-1])]
            yield from np.split(ids, done[ends[first:last - 1] - 1 - begin])
            first = last

    def columns(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each of many texts, some at a time."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + TOGETHER)))
            yield from self.texts(texts[first:last])
            first = last

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return next(self.texts(pa.array([text], pa.string())))


def tokenizer(path: str) -> CachedIds:
    """The tokenizer of a vocabulary file, one for each process."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedIds(path)
    return _tokenizers[path]


class SumOfSquares:
    """Sequences under way, by fill level."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def level(self, size: int) -> int:
        """The fill level to place ``size`` on; 0 opens a sequence."""
        n, top = self.counts, self.length - size
        # Change of the sum: the level loses one, the level reached wins one unless it is full.
        change = 2 * n[size:self.length + 1] + 1
        change[top] = 0
        change[1:] += 1 - 2 * n[1:top + 1]
        change[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        # Of equal changes the fullest level.
        return int(top - np.argmin(change[::-1]))

    def place(self, size: int, fresh) -> tuple[int, int]:
        """The sequence for ``size`` tokens and where in it they start."""
        level = self.level(size)
        if level:
            sequence = self.open[level].pop()
            self.counts[level] -= 1
        else:
            sequence = fresh()
        if level + size < self.length:
            self.open[level + size].append(sequence)
            self.counts[level + size] += 1
        return sequence, level


_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "sequence_tokens long")


def _packed(path: str, length: int, end: int):
    def run(batches):
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        made = [0]

        def fresh() -> int:
            made[0] += 1
            return first + made[0] - 1

        encode, open_, levels = tokenizer(path), {}, SumOfSquares(length)
        # open_: of each sequence under way its pieces, each a document, a start, its tokens and its length in all.
        out: list[tuple] = []

        def close(sequence: int, pieces: list[tuple]) -> None:
            total = sum(len(p[2]) for p in pieces)
            at = 0
            for doc_id, start, ids, tokens in pieces:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, at, total))
                at += len(ids)

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                               [f.split()[0] for f in _SCHEMA.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.columns(batch.column("text"))):
                ids = np.append(ids, np.uint32(end))
                whole = len(ids) - len(ids) % length
                for start in range(0, whole, length):
                    close(fresh(), [(doc_id, start, ids[start:start + length], len(ids))])
                if whole < len(ids):
                    sequence, level = levels.place(len(ids) - whole, fresh)
                    pieces = open_.setdefault(sequence, [])
                    pieces.append((doc_id, whole, ids[whole:].copy(), len(ids)))
                    if level + len(ids) - whole == length:
                        close(sequence, open_.pop(sequence))
                if len(out) >= 20_000:
                    yield rows()
        # Pour what is left together: full sequences, then powers of two, which need no padding.
        left = [p for s in sorted(open_) for p in open_[s]]
        total = sum(len(p[2]) for p in left)
        sizes = [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1)
                                                if (total % length) >> b & 1]
        left.reverse()
        for size in sizes:
            pieces, room = [], size
            while room:
                doc_id, start, ids, tokens = left.pop()
                pieces.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    left.append((doc_id, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
            close(fresh(), pieces)
        if out:
            yield rows()

    return run


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens``.  A document is its ids and then ``end``, so a null or empty text
    is one token; every token lies in one piece.  Sequences shorter than ``length`` are
    powers of two long, so nothing is padded.  Rows are packed in the order of their
    partition and only ever beside rows of it: nothing is shuffled, a task holds one
    sequence per fill level and little more, and a task run again gives the same rows.
    Repeated rows are packed each; a null ``doc_id`` stays null; other columns play no
    part; no rows give none.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _packed(path, length, end), _SCHEMA)
