"""Byte-level BPE by backtracking from longest matches, over rank files of public tokenizers, and decoding."""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import add_columns

#: Bytes that a worker's memory of pre-tokens may take, the longest pre-token that it keeps, and the pairs of tokens that it remembers.
MEMORY, LONGEST, PAIRS = 128 << 20, 128, 1 << 18
#: Pre-tokens of one text that are held at once, and the length from which a text is taken in such portions.
PORTION, LONG_TEXT = 1 << 16, 1 << 20

_NEVER = 1 << 62


class BytePairs:
    """The tokens of a rank file: encoding of pre-tokens to ids, equal to merging the pair of lowest rank first, leftmost on ties.

    Two tokens are compatible if merging their bytes together gives just these two. A text's encoding is the one sequence of tokens
    whose neighbours are all compatible; it is found from left to right, the longest match first and shorter ones after it. An end
    from which no compatible token goes on is marked and never tried again, so the time is linear in the length.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        count = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * count
        for data, i in self.ranks.items():
            self.bytes_of[i] = data
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.size = list(map(len, self.bytes_of))
        self.count = count
        self.shorter = [-1] * count  # the longest token that a token begins with
        self.halves: list[tuple[int, int] | None] = [None] * count
        self.joined: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()  # of reversed tokens, so that matches end where a token begins
        for i, data in enumerate(self.bytes_of):
            if data:
                self._add(i, data)
        self.automaton.make_automaton()

    def _add(self, i: int, data: bytes) -> None:
        heads = [self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks]
        self.shorter[i] = heads[0] if heads else -1
        if len(data) > 1:
            for head in heads:
                tail = self.ranks.get(data[self.size[head] :], _NEVER)
                if head < i and tail < i and self._compatible(head, tail):
                    self.halves[i], self.joined[head * self.count + tail] = (head, tail), i
                    break
            else:
                return  # no merges make it: it is only found as a whole pre-token
        self.automaton.add_word(data[::-1].decode("latin-1"), i)

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges on both sides of the boundary are done before one across it.

        Goes back in time: the part at the boundary that was made last (the right one on ties, as merges go from the left) is
        replaced by its half there, and what the two parts would make is looked up.
        """
        taken_a, taken_b = _NEVER, _NEVER  # ranks of the merges that take the parts away
        while True:
            across = self.joined.get(a * self.count + b, _NEVER)
            if across < taken_a and across <= taken_b and across < _NEVER:
                return False
            made_a, made_b = (a if self.halves[a] else -1), (b if self.halves[b] else -1)
            if made_a > made_b:
                taken_a, a = a, self.halves[a][1]
            elif made_b >= 0:
                taken_b, b = b, self.halves[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.count + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def encode(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, size, shorter = len(data), self.size, self.shorter
        longest = [-1] * n
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            if longest[n - 1 - end] < 0:  # the longest comes first
                longest[n - 1 - end] = token
        found: list[int] = []
        at, token, dead = 0, longest[0] if n else -1, bytearray(n + 1)
        while at < n:
            last = found[-1] if found else -1
            while token >= 0 and (dead[at + size[token]] or not (last < 0 or self.compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                found.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = found.pop()
                at -= size[token]
        return found


class _Memory(dict):
    """Ids of pre-tokens; forgets all when they take more than MEMORY bytes."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs, self.used = pairs, 0

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode()
        ids = self.pairs.encode(data)
        if len(data) <= LONGEST:
            self.used += 250 + 4 * len(data) + 8 * len(ids)  # string, list and place in the table; the ids themselves are shared
            if self.used > MEMORY:
                self.clear()
                self.used = 0
            self[piece] = ids
        return ids


class Codec:
    """Encodes whole texts, pre-token by pre-token, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        self.pairs = BytePairs(path)
        self.memory = _Memory(self.pairs)
        self.pattern = regex.compile(pattern)
        self.names = list(map(str, range(self.pairs.count)))

    def portions(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, those of a long one in several lists."""
        known = self.memory.__getitem__
        if len(text) < LONG_TEXT:
            yield list(itertools.chain.from_iterable(map(known, self.pattern.findall(text))))
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while pieces := list(itertools.islice(found, PORTION)):
            yield list(itertools.chain.from_iterable(map(known, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pairs.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of the whole text of each row, array<int>, by the ranks in a file; a null or empty text has no ids.

    pattern splits texts into pre-tokens; what it does not match is left out, as the library does. Each row stands for itself, so
    repeated rows are encoded alike, and there is no shuffle. A column that has the name of ids, in whatever case, is replaced.
    """

    def run(texts: list[str | None]) -> list:
        c = codec(path, pattern)
        return [[np.fromiter(itertools.chain.from_iterable(c.portions(t or "")), dtype=np.int32) for t in texts]]

    return add_columns(docs, [column], run, f"`{ids}` array<int>")


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """docs with the bytes that ids stand for, binary; null or no ids give no bytes. Cast to string, they are the text encoded."""

    def run(lists: list[list[int] | None]) -> list:
        c = codec(path, pattern)
        return [[c.decode(x or []) for x in lists]]

    return add_columns(docs, [ids], run, f"`{column}` binary")


def round_trip(docs: DataFrame, path: str, pattern: str, column: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the bytes that the
    ids stand for), both lowercase hex. Texts are encoded and decoded as in encode and decode; of a very long one only a portion of
    the ids is held at a time."""

    def run(texts: list[str | None]) -> list:
        c, counts, of_ids, of_bytes = codec(path, pattern), [], [], []
        for text in texts:
            n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in c.portions(text or ""):
                if ids:
                    ids_hash.update(("," if n else "").encode() + ",".join(map(c.names.__getitem__, ids)).encode())
                    bytes_hash.update(c.decode(ids))
                    n += len(ids)
            counts.append(n), of_ids.append(ids_hash.hexdigest()), of_bytes.append(bytes_hash.hexdigest())
        return [pa.array(counts, type=pa.int64()), of_ids, of_bytes]

    rows = docs.withColumn(column, F.coalesce(column, F.lit("")))
    return add_columns(rows, [column], run, "n_tokens long, ids_sha256 string, decoded_sha256 string", drop=(column,))
