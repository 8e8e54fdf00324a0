"""Token counts that follow edits.

A document is kept as its pre-tokens in a segment tree whose nodes hold the
characters and tokens below them.  An edit is found by characters from the root; only
the slots it touches, with one before and as many after as it takes for the
pre-tokens to fall in step again, are cut and encoded anew, and the sums above them
are updated.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of pre-tokens that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a slot when a tree is built.
SLOT = 32
CACHED = 500_000
EDITS = "array<struct<at: long, removed: long, added: string>>"
_counters: dict[str, "TokenCounter"] = {}


class TokenCounter(dict):
    """Tokens of a pre-token, remembered for those met before."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= CACHED:
            self.clear()
        self[piece] = n
        return n


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


class PretokenTree:
    """Segment tree over slots of pre-tokens; node ``i`` has the children ``2i`` and ``2i + 1``."""

    def __init__(self, text: str, count: TokenCounter):
        self.count = count
        pieces = count.cut(text)
        self.slots = [pieces[i:i + SLOT] for i in range(0, len(pieces), SLOT)] or [[]]
        self.leaves = 1 << (len(self.slots) - 1).bit_length()
        self.slots += [[] for _ in range(self.leaves - len(self.slots))]
        self.chars, self.tokens = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, slot in enumerate(self.slots):
            self._sum(i, slot)
        for node in range(self.leaves - 1, 0, -1):
            self._add(node)
        self.encoded = 0

    def _sum(self, i: int, slot: list[str]) -> None:
        self.slots[i] = slot
        self.chars[self.leaves + i] = sum(map(len, slot))
        self.tokens[self.leaves + i] = sum(map(self.count.__getitem__, slot))

    def _add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds character ``at`` (the last one beyond the end), and where it starts."""
        node, start = 1, 0
        at = min(at, max(0, self.chars[1] - 1))
        while node < self.leaves:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters at ``at`` by ``added``; both are cut to the text."""
        size = self.chars[1]
        at = min(max(0, at), size)
        removed = min(max(0, removed), size - at)
        # A pre-token that ends two characters before the edit was cut without seeing it.
        first, start = self.find(max(0, at - 2))
        last, end = self.find(at + removed)
        end += self.chars[self.leaves + last]
        old = "".join("".join(s) for s in self.slots[first:last + 1])
        new = old[:at - start] + added + old[at - start + removed:]
        while True:
            # In step again: a pre-token ends where the old slot ended, seeing what follows.
            rest, after = "", last + 1
            while after < self.leaves and len(rest) < 3:
                rest += "".join(self.slots[after])
                after += 1
            pieces, length = [], 0
            for piece in self.count.cut(new + rest):
                if length >= len(new):
                    break
                pieces.append(piece)
                length += len(piece)
            if length == len(new) and end >= at + removed:
                break
            new += rest
            end += len(rest)
            last = after - 1
        self.encoded += len(pieces)
        self._sum(first, pieces)
        touched = {(self.leaves + first) // 2}
        for i in range(first + 1, last + 1):
            if self.slots[i]:
                self._sum(i, [])
                touched.add((self.leaves + i) // 2)
        while touched and 0 not in touched:
            for node in touched:
                self._add(node)
            touched = {node // 2 for node in touched}

    def text(self) -> str:
        return "".join("".join(s) for s in self.slots)


def _counted(path: str):
    def run(batches):
        count = counter(path)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                tree = PretokenTree(text or "", count)
                before, pieces = tree.tokens[1], sum(map(len, tree.slots))
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["added"] or "")
                rows.append((pieces, before, tree.tokens[1], tree.chars[1], tree.encoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))] if rows else
                [batch.column("doc_id"), *(pa.array([], pa.int64()) for _ in range(5))],
                ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_reencoded"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """Token counts of every row's whole text before and after its ``edits``.

    ``docs`` has ``doc_id``, ``text`` and ``edits``, an array of ``at, removed, added``
    that are applied in order, each to the text the one before left; see
    ``with_edits`` for edits in a table of their own.  Null or empty texts have no
    tokens and can be added to; null edits, or null members of one, change nothing;
    places beyond the text are cut to it.  ``n_reencoded`` counts the pre-tokens that
    edits had cut anew.  Rows stand for themselves: repeated rows count alike, a null
    ``doc_id`` stays null, other columns play no part, no rows give none.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("edits").cast(EDITS)).mapInArrow(
        _counted(path), "doc_id long, n_pretokens long, n_tokens long, n_tokens_edited long, n_chars_edited long, "
                        "n_reencoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the rows of ``edits`` (``doc_id, step, at, removed, added``) of each document, by ``step``."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("step", "at", "removed", "added"))).alias("e"))
    own = own.select("doc_id", F.transform("e", lambda e: F.struct(e["at"], e["removed"], e["added"])).cast(EDITS).alias("edits"))
    return docs.drop("edits").join(own, "doc_id", "left")
