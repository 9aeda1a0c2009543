"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is encoded by halves: each half becomes an element, and neighbouring
elements are joined by encoding again only a window around the seam, which
grows until what lies outside it provably stays as it is. There are two
levels of the same reduction:

* Text level. An element is the pattern's matches of a stretch of text with
  the tokens of each. A match reads at most ``LOOK`` characters beyond its
  own end, so matches that end ``LOOK`` characters before the seam stand. From
  a match start on, the right half's matches depend on nothing to their left,
  so the window ends at the first of its boundaries that the right half has
  too.
* Byte level, inside one match. An element is the token sequence of a stretch
  of bytes. A sequence is the encoding of its bytes exactly if each pair of
  neighbours encodes to itself, so a window stands once the pairs on both of
  its edges do.

Decoding concatenates token bytes up the same kind of tree.

Cases: null and empty texts have no tokens; rows are handled one by one, so
repeated rows, null ids and clashing extra columns change nothing; an empty
table gives an empty table; very long texts and very long single words take
n log n steps.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_document

#: Characters that the pattern may read beyond a match: two for white space before a word, two more within a contraction.
LOOK = 3
#: Characters of a text, bytes of a match, ids of a sequence that are handled without a further cut.
TEXT_LEAF, BYTE_LEAF, ID_LEAF = 2048, 16, 4096
#: Distinct matches whose tokens a task remembers; the memo starts anew when full.
MEMO = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Memo(dict):
    """Match to packed tokens, made on first use."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, match: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        self[match] = out = self.make(match)
        return out


class ByteBPE:
    """Encoder and decoder over a rank table and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(pattern)
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.memo = _Memo(self._pack)
        self.stable: dict[tuple[int, int], bool] = {}

    # -- bytes of one match -------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes: merge the lowest-ranked neighbours first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank_of = self.ranks.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = rank_of(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def pair_stands(self, left: int, right: int) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            if len(self.stable) >= MEMO:
                self.stable.clear()
            known = self.stable[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbouring stretches of bytes, by a growing window around their seam."""
        if not left or not right or self.pair_stands(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = left[len(left) - a :] + right[:b]
            middle = self._window(b"".join(map(self.bytes_of.__getitem__, window)))
            left_holds = a == len(left) or self.pair_stands(left[-a - 1], middle[0])
            right_holds = b == len(right) or self.pair_stands(middle[-1], right[b])
            if left_holds and right_holds:
                return left[: len(left) - a] + middle + right[b:]
            a = a if left_holds else min(len(left), 2 * a)
            b = b if right_holds else min(len(right), 2 * b)

    def _window(self, data: bytes) -> list[int]:
        return self.merge(data) if len(data) <= 64 else self.reduce_bytes(data, 0, len(data))

    def reduce_bytes(self, data: bytes, start: int, end: int) -> list[int]:
        if end - start <= BYTE_LEAF:
            return self.merge(data[start:end])
        middle = (start + end) // 2
        return self.join_tokens(self.reduce_bytes(data, start, middle), self.reduce_bytes(data, middle, end))

    def _pack(self, match: str) -> bytes:
        data = match.encode("utf-8", "replace")
        if data in self.ranks:
            ids = [self.ranks[data]]
        elif len(data) <= BYTE_LEAF:
            ids = self.base._encode_single_piece(data)
        else:
            ids = self.reduce_bytes(data, 0, len(data))
        return np.asarray(ids, "<u4").tobytes()

    # -- matches of a text --------------------------------------------------

    def _leaf(self, text: str) -> tuple[list[str], list[bytes]]:
        matches = self.pattern.findall(text)
        return matches, list(map(self.memo.__getitem__, matches))

    def join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """Join two elements: matches well inside either half stay, the window between them is split and encoded again."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        cut, loose = len(left[0]), 0
        while cut and loose < LOOK:
            cut -= 1
            loose += len(left[0][cut])
        tail, taken = "".join(left[0][cut:]), 2
        while True:
            taken = min(taken, len(right[0]))
            window = tail + "".join(right[0][:taken])
            if taken == len(right[0]):
                matches, resume = self.pattern.findall(window), taken
                break
            ends, at = {}, len(tail)
            for i in range(taken):
                at += len(right[0][i])
                ends[at] = i + 1
            matches, at, resume = [], 0, None
            for match in self.pattern.findall(window):
                at += len(match)
                if at > len(window) - LOOK:
                    break
                matches.append(match)
                if at in ends:
                    resume = ends[at]
                    break
            if resume is not None:
                break
            taken *= 2
        return left[0][:cut] + matches + right[0][resume:], left[1][:cut] + list(map(self.memo.__getitem__, matches)) + right[1][resume:]

    def _reduce(self, text: str, start: int, end: int) -> tuple[list[str], list[bytes]]:
        if end - start <= TEXT_LEAF:
            return self._leaf(text[start:end])
        middle = (start + end) // 2
        return self.join(self._reduce(text, start, middle), self._reduce(text, middle, end))

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self._reduce(text, 0, len(text))[1])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= ID_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def worker_bpe(path: str, pattern: str) -> ByteBPE:
    """The encoder of a Python worker, which serves all of its tasks."""
    return ByteBPE(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): ids is the binary of little-endian unsigned 32-bit tokens of each whole text."""

    def make():
        bpe = worker_bpe(path, pattern)
        return lambda blob: (bpe.encode_packed(blob.decode("utf-8", "replace")),)

    return per_document(docs, [id], make, f"{id} {docs.schema[id].dataType.simpleString()}, ids binary", text)


def decode(encoded: DataFrame, path: str, pattern: str, id: str = "doc_id") -> DataFrame:
    """(id, decoded): the bytes of a packed ids column."""

    def make():
        bpe = worker_bpe(path, pattern)
        return lambda blob: (bpe.decode(np.frombuffer(blob, "<u4").tolist()),)

    return per_document(encoded, [id], make, f"{id} {encoded.schema[id].dataType.simpleString()}, decoded binary", "ids")


def round_trip(docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids, decoded) in one pass: encode every whole text, then decode the ids made."""

    def make():
        bpe = worker_bpe(path, pattern)

        def one(blob: bytes) -> tuple[bytes, bytes]:
            packed = bpe.encode_packed(blob.decode("utf-8", "replace"))
            return packed, bpe.decode(np.frombuffer(packed, "<u4").tolist())

        return one

    return per_document(docs, [id], make, f"{id} {docs.schema[id].dataType.simpleString()}, ids binary, decoded binary", text)


def digest_columns(id: str = "doc_id") -> list[Column]:
    """id, n_tokens, ids_sha256 and decoded_sha256 of a round trip's columns."""
    return [F.col(id), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def digests(coded: DataFrame, id: str = "doc_id") -> DataFrame:
    return coded.select(*digest_columns(id))
