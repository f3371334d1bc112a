"""Fixed-length training sequences: documents are tokenised, cut and packed by multiway differencing."""

from __future__ import annotations

import heapq
import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import small_batches

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 1
#: The rest of a document, after its full sequences, is cut into pieces of at most this many tokens.
PIECE = 512
#: Windows that are balanced together: a group closes when its pieces fill about as many.
WINDOWS = 96
#: What a group may leave free in all: enough for windows that are near-equal, not equal, and less than one window.
SLACK = range(500, 1100)
#: Bytes of words and white-space-free chunks, with their ids, that a worker remembers; it forgets those that were not met of late.
REMEMBERED = 60_000_000
#: What an entry takes besides its characters and ids: two objects and a place in the dictionary.
ENTRY = 130


class WordTokenizer:
    """Ids of a tokenizers file whose pieces never cross white space, word by word with a memory.

    Equal to encode(text, add_special_tokens=False) on whole texts: the file's normaliser (NFC, one space, lower case) is
    repeated here, and each distinct run without white space goes through the file's own pipeline once.
    """

    def __init__(self, path: str):
        # A task has one core; threads of the library's own would each keep memory of their own in every worker.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # Special strings; a letter whose lower case depends on its place; white space to Python only.
        self.rare = [t.content for t in self.whole.get_added_tokens_decoder().values()] + ["Σ", *"\x1c\x1d\x1e\x1f"]
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: Chunks met of late, with about how many bytes they take, and those met before them.
        self.ids: dict[str, bytes] = {}
        self.held = 0
        self.before: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        ids_of, plain = self.ids, [c for c in chunks if c.isalpha()]
        if len(plain) < len(chunks):
            rest = [c for c in chunks if not c.isalpha()]
            for c, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                ids_of[c] = np.array(e.ids, dtype="<u4").tobytes()
        # Many words in one string, kept apart by a space; every word ends in a piece that says so.
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for some, e in zip(groups, self.whole.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(some):
                for w in some:
                    ids_of[w] = np.array(self.whole.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            data, at = ids.tobytes(), 0
            for w, end in zip(some, (stop * 4).tolist(), strict=True):
                ids_of[w] = data[at:end]
                at = end

    def _chunks(self, text: str) -> list[str] | None:
        if any(x in text for x in self.rare):
            return None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        # A lone full stop or comma after a letter is a word of its own; set apart, the word before it is one that is known.
        if not _CLUSTER.search(text):
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        chunks = [self._chunks(t) for t in texts]
        ids_of, old = self.ids, self.before.get
        new = set().union(*(c for c in chunks if c)).difference(ids_of)
        unknown = []
        for x in new:
            if (v := old(x)) is None:
                unknown.append(x)
            else:
                ids_of[x] = v
        self._learn(unknown)
        self.held += sum([len(x) + len(ids_of[x]) for x in new]) + len(new) * ENTRY
        if self.held > REMEMBERED // 2:
            self.before, self.ids, self.held = ids_of, {}, 0  # `ids_of` still has what this call needs
        return [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4") if c is None
            else np.frombuffer(b"".join(map(ids_of.__getitem__, c)), dtype="<u4")
            for t, c in zip(texts, chunks, strict=True)
        ]


#: A full stop or comma beside another character that is neither letter, digit nor white space.
_CLUSTER = re.compile(r"[.,](?:(?![\s\w])(?!\Z)|(?=_)|(?<=[^\w\s].)|(?<=_.))")

_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp differencing into `ways` parts: the indices of each part.

    Each item begins as a partial partition of its own. The two partial partitions of the largest spread are merged, the
    heaviest part of one with the lightest of the other, until one is left.
    """
    # A partial partition holds its parts that are not empty, heaviest first; the empty ones are implied.
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = itertools.count(len(sizes))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        alone = ways - len(b)  # so many of the heaviest parts of a meet an empty part of b
        merged = a[:alone] + [(x + y, p + q) for (x, p), (y, q) in zip(a[alone:], b[::-1], strict=False)] + b[: ways - max(len(a), alone)]
        merged.sort(key=lambda part: -part[0])
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == ways else 0) - merged[0][0], next(fresh), merged))
    return [items for _, items in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; one more window as long as the heaviest holds too much."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, ways)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        ways += 1


def cuts(tokens: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences first, then the rest in pieces of at most PIECE."""
    full = tokens - tokens % CAPACITY
    out = [(s, CAPACITY) for s in range(0, full, CAPACITY)]
    return out + [(s, min(PIECE, tokens - s)) for s in range(full, tokens, PIECE)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs needs doc_id and text; other columns are ignored. A document is its ids and then END (a null or empty text: END
    alone). Each id lies in exactly one piece. with_ids adds the ids (array<int>), which a trainer reads; the digest columns are
    made of the same ids. Rows that share a doc_id are packed each for itself.

    Every task tokenises its rows and packs what they leave over in groups of about WINDOWS windows, so nothing is shuffled and
    a task holds one group. A full sequence needs no partner. sequence_id is the task's number times 2**40 and a count, so it is
    the same when a lost task is run again. At most one window's worth is padded in each group.
    """
    small_batches(docs.sparkSession)
    schema = T._parse_datatype_string(PIECES + (", ids array<int>" if with_ids else ""))
    schema.fields[0].dataType = docs.schema["doc_id"].dataType
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, sequence = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        waiting, load = [], 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal sequence, load
            for w in windows([r[2] for r in waiting]) if waiting else []:
                offset = 0
                for i in w:
                    r = waiting[i]
                    out.append((*r[:5], sequence, offset, *r[5:]))
                    offset += r[2]
                sequence += 1
            waiting.clear()
            load = 0

        def lists(parts: tuple[np.ndarray, ...], kind: pa.DataType) -> pa.ListArray:
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts)), type=kind)

        def batch() -> pa.RecordBatch:
            columns = [lists(c, f.type) if f.name == "ids" else pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for b in batches:
            coded = tok.encode_all([t or "" for t in b.column(1).to_pylist()])
            for doc, own in zip(b.column(0).to_pylist(), coded, strict=True):
                ids = np.append(own, np.uint32(END)).astype("<u4")
                for start, length in cuts(len(ids)):
                    own = ids[start : start + length]
                    row = (doc, start, length, zlib.crc32(own.tobytes()), len(ids), *([own.astype(np.int32)] if with_ids else []))
                    if length == CAPACITY:
                        out.append((*row[:5], sequence, 0, *row[5:]))
                        sequence += 1
                    else:
                        waiting.append(row)
                        load += length
                if load >= WINDOWS * CAPACITY and -load % CAPACITY in SLACK:
                    close()
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
