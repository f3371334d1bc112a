"""Merge-type subword encoding with seeded dropout, and its decoding."""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_right
from itertools import repeat
from operator import add

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import add_columns, mix

#: Share of candidate merges that are skipped, and the seed.
DROPOUT, SEED = 0.1, 20240601
#: Bytes, about, that what a worker remembers of chunks may take; it forgets all when it takes more.
REMEMBERED = 200 << 20
#: Most skips of a segmentation that is remembered; those with more seldom come again.
DEEP = 2
#: Longest chunk, in characters, whose agenda is a flat list, and that is remembered.
SHORT = 48
#: Chunks that are looked up together, about, and as many characters of whole texts; columns of one matrix of agendas (a power of two).
TOGETHER, LETTERS, COLUMNS = 1 << 18, 1 << 22, 1 << 12
#: Stand for candidates that pass before the first skip where nothing is skipped, and for candidates of a chunk not yet counted.
NEVER, UNKNOWN = (1 << 21) - 1, 1 << 30
SPACE = "▁"
#: Marks that may end a word; a chunk ends between a letter or digit and those that no piece of the vocabulary joins to one.
MARKS = ".,;:!?&()\"«»…"


def _waits(floor: int) -> list[int]:
    """Bounds among 64-bit draws: as many as a draw reaches are the candidates that pass before one is skipped (a geometric law).

    What is left beyond the last bound is less than 2**-53, or begins after a million candidates.
    """
    left, out = 1.0, []
    while floor and left > 2**-53 and len(out) < 1 << 20:
        left *= 1 - floor / 2**32
        out.append(int((1 - left) * 2**64))
    return out


def _next(draw: int) -> int:
    return xxhash.xxh64_intdigest(b"", draw)


def _next_all(draws: np.ndarray) -> np.ndarray:
    """_next of each draw: XXH64 of no bytes, seeded with it."""
    x = draws + np.uint64(0x27D4EB2F165667C5)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    x ^= x >> np.uint64(32)
    return x


def _draws(seeds: list[int], places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The draws of runs of chunks, one run after another: those of a seed from a place on."""
    start = np.array([_next(s & 0xFFFFFFFFFFFFFFFF) for s in seeds], dtype=np.uint64)
    return mix(np.repeat(start, counts) + _runs(places, counts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1 and so on of each run, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """Longs of 0 and more and a number below 2**31 for each, by open addressing; at most a quarter is filled."""

    def __init__(self):
        self._clear(12)

    def _clear(self, bits: int) -> None:
        self.n, self.keys, self.values = 0, np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or a free one."""
        at = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.keys).bit_length())).view(np.int64)
        got = self.keys[at]
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            got = self.keys[at[todo]]
            todo = todo[(got != keys[todo]) & (got >= 0)]
        return at

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = self._find(keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that differ and are not there."""
        if 4 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self._clear(2 + len(keys).bit_length())
        self.n += len(keys)
        while len(keys):
            at = self._find(keys)
            self.keys[at] = keys
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values = keys[~mine], values[~mine]


class Memory(dict):
    """Segmentations of chunks by the skips made, whatever the draws; as a dict, the node of each short chunk (a new one where missing).

    A chunk's node is its segmentation without skips. From a node, the number of candidates that pass before one is skipped leads
    to another. A node may be there before its segmentation is: its number of candidates is then UNKNOWN.
    """

    def __init__(self, size: int):
        self.n, self.used, self.pool = 0, 0, np.zeros(1 << 16, dtype=np.uint16 if size <= 1 << 16 else np.uint32)
        #: Candidates after the last skip, place in the pool, number of ids, and skips.
        self.passed, self.start, self.size, self.skips = np.full(1 << 12, UNKNOWN, dtype=np.int32), *(np.zeros(1 << 12, dtype=t) for t in (np.int64, np.int32, np.int32))
        self.children = Table()

    def __missing__(self, chunk: str) -> int:
        if len(chunk) > SHORT:
            return -1
        self[chunk] = n = self.n
        self.n += 1
        return n

    def nbytes(self) -> int:
        return 200 * len(self) + 20 * self.n + 12 * len(self.children.keys) + self.used * self.pool.itemsize

    def fit(self) -> None:
        """Makes room for all nodes."""
        if self.n > len(self.passed):
            more = max(self.n, 2 * len(self.passed)) - len(self.passed)
            self.passed = np.concatenate([self.passed, np.full(more, UNKNOWN, dtype=np.int32)])
            self.start, self.size, self.skips = (np.concatenate([x, np.zeros(more, dtype=x.dtype)]) for x in (self.start, self.size, self.skips))

    def hold(self, ids: np.ndarray) -> int:
        """Puts ids into the pool and gives their place."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(self.used, 2 * len(self.pool)) - at, dtype=self.pool.dtype)])
        self.pool[at : self.used] = ids
        return at

    def path(self, node: np.ndarray, waits: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """The node that each node's waits lead to, as many of them as skips says; made where it is missing."""
        node = node.copy()
        for level in range(DEEP):
            on = np.flatnonzero(skips > level)
            keys = node[on] << 21 | waits[level, on]
            known, back = np.unique(keys, return_inverse=True)
            child = self.children.get(known)
            new = np.flatnonzero(child < 0)
            child[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
            self.fit()
            self.skips[child[new]] = level + 1
            self.children.put(known[new], child[new])
            node[on] = child[back]
        return node

    def learn(self, node: np.ndarray, passed: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.passed[node], self.start[node], self.size[node] = passed, start, size


class Pieces:
    """The pieces of a sentencepiece model of merge type with byte fallback; seeds make its segmentations vary."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.id_of = {names[i]: i for i in plain}
        #: Merges happen in the order of scores, best first.
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = {names[i]: r for r, i in enumerate(order)}
        self.names = [names[i] for i in order]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes_of = np.full(size, b"", dtype=object)
        for i in plain:
            self.bytes_of[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.bytes_of[i] = bytes([b])
        self.memory = self._forget()
        self.pairs: tuple | None = None
        self.waits: dict[int, tuple[list[int], np.ndarray]] = {}
        #: What one run of merges can reach: no piece crosses from a word to the space before the next, a line end, or a mark of that kind.
        joined = {y for p in self.rank for x, y in zip(p, p[1:]) if x.isalnum()}
        marks = re.escape("".join(c for c in MARKS if c not in joined) or "\n")
        other = rf"[^ \n\0{marks}]*+"
        self.chunks = re.compile(rf"\n|\0| *[{marks}]*(?:{other}(?<![^\W_])[{marks}]+)*{other}" if marks != "\\\n" else rf"\n|\0| *{other}").findall

    def _forget(self) -> Memory:
        self.memory = memory = Memory(len(self.bytes_of))
        # Marks and zeros that the text itself holds are spelt in bytes.
        for name, data in (("\0", SPACE.encode()), ("\0\0", b"\0")):
            ids = np.array([self.byte_id[b] for b in data])
            memory.learn(np.array([memory[name]]), 0, memory.hold(ids), len(ids))
        return memory

    def merge(self, chunk: str, key: int | None, floor: int) -> tuple[list[str], tuple[int, ...], int]:
        """The symbols of a chunk after the agenda is empty, the skips, and the number of candidates after the last skip.

        The agenda holds adjacent pairs that form a piece, best rank first, leftmost first of equals. A popped candidate is
        skipped with the chance floor / 2**32. The draws follow from the key: each tells how many candidates pass before the
        next skip, and the skips are named by these numbers; key None skips nothing. A word's agenda is a flat list, whose
        least entry is quick to find; that of a long run of characters is a heap. Both give the same.
        """
        return (self._merge_short if len(chunk) <= SHORT else self._merge_long)(chunk, key, floor)

    def _bounds(self, floor: int) -> tuple[list[int], np.ndarray]:
        if floor not in self.waits:
            bounds = _waits(floor)
            self.waits[floor] = bounds, np.array([min(b, 2**64 - 1) for b in bounds], dtype=np.uint64)
        return self.waits[floor]

    def _merge_short(self, chunk: str, key: int | None, floor: int) -> tuple[list[str], tuple[int, ...], int]:
        symbols, get, names, none = list(chunk), self.rank.get, self.names, len(self.names)
        agenda = list(map(get, map(add, chunk, chunk[1:]), repeat(none)))
        bounds = self._bounds(floor)[0] if key is not None and floor else None
        due, passed, skips = bisect_right(bounds, key) if bounds else -1, 0, []
        while agenda and (r := min(agenda)) < none:
            i = agenda.index(r)
            if passed == due:
                skips.append(due)
                key = _next(key)
                due, passed = bisect_right(bounds, key), 0
                agenda[i] = none
                continue
            passed += 1
            symbols[i] = piece = names[r]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(piece + symbols[i + 1], none)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + piece, none)
        return symbols, tuple(skips), passed

    def _merge_long(self, chunk: str, key: int | None, floor: int) -> tuple[list[str], tuple[int, ...], int]:
        symbols: list[str | None] = list(chunk)
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        bounds = self._bounds(floor)[0] if key is not None and floor else None
        due, passed, skips = bisect_right(bounds, key) if bounds else -1, 0, []
        while agenda:
            r, i, piece = heapq.heappop(agenda)
            j = after[i] if symbols[i] is not None else n
            if j >= n or symbols[i] + symbols[j] != piece:
                continue
            if passed == due:
                skips.append(due)
                key = _next(key)
                due, passed = bisect_right(bounds, key), 0
                continue
            passed += 1
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(p := piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (r, h, p))
        return [s for s in symbols if s is not None], tuple(skips), passed

    def _table(self) -> tuple[np.ndarray, np.ndarray, Table]:
        """For runs of merges in bulk: the rank of each character (or -1), ids by rank, and the rank of the piece that a pair of ranks forms."""
        if self.pairs is None:
            rank, n = self.rank, len(self.names)
            found = {}
            for p, r in rank.items():
                for k in range(1, len(p)):
                    a, b = rank.get(p[:k]), rank.get(p[k:])
                    if a is not None and b is not None:
                        found[a * (n + 1) + b] = r
            of_char = np.full(0x110000, -1, dtype=np.int32)
            for p, r in rank.items():
                if len(p) == 1:
                    of_char[ord(p)] = r
            table = Table()
            table.put(np.fromiter(found, dtype=np.int64, count=len(found)), np.fromiter(found.values(), dtype=np.int32, count=len(found)))
            self.pairs = of_char, np.array([self.id_of[x] for x in self.names]), table
        return self.pairs

    def _merge_all(self, chunks: list[str], waits: np.ndarray, draws: np.ndarray, floor: int) -> tuple[np.ndarray, ...]:
        """The ids of chunks as merge and spell give them, one chunk's after another's, and of each chunk: how many ids, candidates after the last skip, how many skips, and the first ones.

        waits tells how many candidates pass before the first skip, which the draw also tells. The agendas of many short chunks
        are columns of one matrix; each round takes the best candidate of every column.
        """
        of_char, id_of, table = self._table()
        none, n, m = len(self.names) << 6, len(self.names), len(chunks)
        bounds = self._bounds(floor)[1]
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=m)
        # Long ones and those with a character that is no piece are merged one by one.
        alone = sizes > SHORT
        codes = of_char[np.frombuffer("".join(c for c in chunks if len(c) <= SHORT).encode("utf-32-le"), dtype="<u4")]
        sizes[alone] = 0
        begin = np.cumsum(sizes) - sizes
        alone[np.repeat(np.arange(m), sizes)[codes < 0]] = True
        order = np.argsort(sizes, kind="stable")
        order = order[~alone[order]]
        (count, passed, skips), first = np.zeros((3, m), dtype=np.int64), np.zeros((DEEP, m), dtype=np.int64)
        made, blocks = [], []

        def candidate(a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
            r = table.get(a.astype(np.int64) * (n + 1) + b)
            return np.where(r >= 0, r << 6 | i, none)

        for low in range(0, len(order), COLUMNS):
            mine = order[low : low + COLUMNS]
            bits = (len(mine) - 1).bit_length()
            w, size = 1 << bits, np.zeros(1 << bits, dtype=np.int64)
            size[: len(mine)] = sizes[mine]
            high = int(size.max()) + 2
            # Symbols stand at 1 to size; before and after them is one that joins nothing. A place and a column are one number.
            place = np.arange(high, dtype=np.int64)[:, None]
            inside = (place >= 1) & (place <= size)
            sym = np.full((high, w), n, dtype=np.int32)
            sym.T[inside.T] = codes[_runs(begin[mine], sizes[mine])]
            agenda = np.full((high, w), none, dtype=np.int32)
            pair = np.flatnonzero(inside[:-1] & inside[1:])
            flat, queue, held = sym.ravel(), agenda.ravel(), inside.ravel()
            queue[pair] = candidate(flat[pair], flat[pair + w], pair >> bits)
            after, before = np.arange(w, w * high + w), np.arange(-w, w * high - w)
            key, due = draws[mine], waits[mine]
            (gone, skipped), early = np.zeros((2, w), dtype=np.int64), np.zeros((DEEP, w), dtype=np.int64)
            while True:
                best = agenda.min(axis=0)
                c = np.flatnonzero(best < none)
                if not len(c):
                    break
                best = best[c]
                late = gone[c] == due[c]
                at = ((best & 63).astype(np.int64) << bits) + c
                if late.any():
                    cut = c[late]
                    for level in range(DEEP):
                        x = cut[skipped[cut] == level]
                        early[level, x] = due[x]
                    skipped[cut] += 1
                    key[cut] = _next_all(key[cut])
                    due[cut], gone[cut] = np.searchsorted(bounds, key[cut], side="right"), 0
                    queue[at[late]] = none
                    c, at, best = c[~late], at[~late], best[~late]
                gone[c] += 1
                r, j, h = best >> 6, after[at], before[at]
                k = after[j]
                flat[at], flat[j], queue[j], held[j] = r, n, none, False
                after[at], before[k] = k, at
                left = np.concatenate([at, h])
                queue[left] = candidate(flat[left], np.concatenate([flat[k], r]), left >> bits)
            made.append(id_of[sym.T[inside.T]])
            blocks.append(mine)
            v = len(mine)
            count[mine], passed[mine], skips[mine], first[:, mine] = inside.sum(axis=0)[:v], gone[:v], skipped[:v], early[:, :v]
        for x in np.flatnonzero(alone).tolist():
            symbols, cut, passed[x] = self.merge(chunks[x], int(draws[x]) if waits[x] < NEVER else None, floor)
            made.append(np.array(self.spell(symbols), dtype=np.int64))
            blocks.append([x])
            count[x], skips[x], first[: len(cut), x] = len(made[-1]), len(cut), cut[:DEEP]
        order = np.concatenate(blocks).astype(np.int64)
        start = np.zeros(m, dtype=np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate(made)[_runs(start, count)], count, passed, skips, first

    def spell(self, symbols: list[str]) -> list[int]:
        ids = list(map(self.id_of.get, symbols))
        return ids if None not in ids else [i for s, own in zip(symbols, ids) for i in ([self.byte_id[b] for b in s.encode()] if own is None else [own])]

    def _parts(self, text: str) -> list[tuple[int, list[str]]]:
        """The chunks of a text between those \0 that it holds, each list with the place of its first chunk's draw; \0 is a chunk that stands for a mark."""
        parts = (" " + text).split("\0") if text else []
        return [(i << 40, self.chunks(p.replace(SPACE, "\0"))) for i, p in enumerate(parts)]

    def encode(self, text: str, seed: int | None = SEED, dropout: float = DROPOUT) -> tuple[np.ndarray, int]:
        """Ids of a text and the number of skipped merges, chunk by chunk and without memory; seed None gives the model's own segmentation.

        Every chunk has a draw of its own, made of the seed and its place in the text, so a word is cut anew each time.
        """
        floor, ids, skipped = int(dropout * 2**32), [], 0
        for place, chunks in self._parts(text):
            ids += [self.byte_id[0]] if place else []
            draws = [None] * len(chunks) if seed is None else _draws([seed], np.array([place]), np.array([len(chunks)])).tolist()
            for c, draw in zip(chunks, draws, strict=True):
                if c == "\0":
                    ids += [self.byte_id[b] for b in SPACE.encode()]
                    continue
                symbols, cut, _ = self.merge(c.replace(" ", SPACE), draw, floor)
                ids += self.spell(symbols)
                skipped += len(cut)
        return np.array(ids, dtype="<u4"), skipped

    def encode_all(self, texts: list[str], seeds: list[int | None], dropout: float = DROPOUT) -> list[tuple[np.ndarray, int]]:
        """What encode gives for each text. Chunks are looked up in memory together, and those that it does not hold are merged together."""
        floor, got, skipped = int(dropout * 2**32), [[] for _ in texts], [0] * len(texts)
        chunks: list[str] = []
        runs: list[tuple[int | None, int, int]] = []
        ends: list[tuple[int, int]] = []
        letters = 0

        def settle() -> None:
            ids, bounds, skips = self._settle(chunks, runs, floor, np.array([e for _, e in ends], dtype=np.int64))
            for (x, _), a, b, k in zip(ends, [0, *bounds], bounds, skips):
                got[x].append(ids[a:b])
                skipped[x] += k
            chunks.clear(), runs.clear(), ends.clear()

        for x, (text, seed) in enumerate(zip(texts, seeds, strict=True)):
            for place, found in self._parts(text):
                if place:
                    chunks.append("\0\0")
                    runs.append((None, 0, 1))
                # A long text goes on in the next lot.
                for low in range(0, len(found), TOGETHER):
                    some = found[low : low + TOGETHER]
                    chunks += some
                    runs.append((seed, place + low, len(some)))
                    if len(chunks) >= TOGETHER:
                        ends.append((x, len(chunks)))
                        settle()
            ends.append((x, len(chunks)))
            letters += len(text)
            if letters > LETTERS:
                settle()
                letters = 0
        settle()
        return [(g[0] if len(g) == 1 else np.concatenate(g), k) for g, k in zip(got, skipped)]

    def _settle(self, chunks: list[str], runs: list[tuple[int | None, int, int]], floor: int, ends: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """The ids of all chunks, and of the texts that end at ends, where their ids end and their number of skips.

        runs has the seed (None: no skips), the place of the first draw and the number of chunks.
        """
        memory = self.memory if self.memory.nbytes() <= REMEMBERED else self._forget()
        node = np.fromiter(map(memory.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        memory.fit()
        bounds = self._bounds(floor)[1]
        counts = np.array([n for *_, n in runs], dtype=np.int64)
        draws = _draws([s or 0 for s, *_ in runs], np.array([p for _, p, _ in runs], dtype=np.int64), counts)
        drawn = np.repeat(np.array([s is not None and floor > 0 for s, *_ in runs], dtype=bool), counts)
        waits = np.where(drawn, np.searchsorted(bounds, draws, side="right"), NEVER)
        root, todo = node.copy(), [np.flatnonzero(node < 0)]
        # What is remembered is looked up by the skips that the draws make, so it gives what a new run would.
        on = np.flatnonzero((node >= 0) & (waits < memory.passed[node]))
        wait, key = waits[on], draws[on]
        while len(on):
            child = memory.children.get(node[on] << 21 | wait)
            todo.append(on[child < 0])
            held = child >= 0
            on, key = on[held], _next_all(key[held])
            node[on] = child[held]
            wait = np.searchsorted(bounds, key, side="right")
            more = wait < memory.passed[node[on]]
            on, key, wait = on[more], key[more], wait[more]
        todo = np.concatenate(todo)
        start, size, skips = memory.start[node], memory.size[node], memory.skips[node].astype(np.int64)
        kept = memory.used
        if len(todo):
            ids, count, passed, cut, first = self._merge_all([chunks[x].replace(" ", SPACE) for x in todo.tolist()], waits[todo], draws[todo], floor)
            keep = (root[todo] >= 0) & (cut <= DEEP)
            # What is remembered comes first in the pool, the rest is given and forgotten.
            order = np.argsort(~keep, kind="stable")
            at = memory.hold(ids[_runs((np.cumsum(count) - count)[order], count[order])])
            place = np.empty(len(todo), dtype=np.int64)
            place[order] = at + np.cumsum(count[order]) - count[order]
            memory.learn(memory.path(root[todo[keep]], first[:, keep], cut[keep]), passed[keep], place[keep], count[keep])
            start[todo], size[todo], skips[todo] = place, count, cut
            kept = at + int(count[keep].sum())
        ids = memory.pool[_runs(start, size.astype(np.int64))].astype("<u4")
        memory.used = kept
        total = [np.concatenate([[0], np.cumsum(x)])[ends].tolist() for x in (size, skips)]
        return ids, total[0], np.diff(total[1], prepend=0).tolist()

    def decode(self, ids) -> str:
        """The text: pieces joined, marks as spaces, without the first mark. The inverse of encode for every seed."""
        return b"".join(self.bytes_of[np.asarray(ids, dtype=np.int64)].tolist())[1:].decode()


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode(docs: DataFrame, model_path: str, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """docs with ids (array<int>) and n_skipped.

    docs needs doc_id and text; every other column stays (those named as results are replaced). A null or empty text has no ids.
    Every occurrence of a word is cut by draws of its own, keyed by the seed, the doc_id and the place in the text. Workers
    remember a word's ids by the skips made, which depends on no key. Other seeds give other segmentations. dropout 0 gives the
    model's own.
    """

    def run(keys: list, texts: list) -> list[list]:
        model = pieces(model_path)
        got = model.encode_all([t or "" for t in texts], keys if dropout > 0 else [None] * len(keys), dropout)
        return [[g[0].astype(np.int32) for g in got], [g[1] for g in got]]

    keyed = docs.withColumn("_key", F.xxhash64("doc_id", F.lit(seed)))
    return add_columns(keyed, ["_key", "text"], run, "ids array<int>, n_skipped long", drop=("_key",))


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """coded with decoded (string) made of ids; null ids give an empty text."""
    return add_columns(coded, ["ids"], lambda ids: [[pieces(model_path).decode(i or []) for i in ids]], "decoded string")


def round_trip(docs: DataFrame, model_path: str, seed: int = SEED, dropout: float = DROPOUT) -> DataFrame:
    """doc_id, n_pieces, n_skipped, ids_crc32 and lossless of each document: encode, decode and compare in one pass."""

    def run(keys: list, texts: list) -> list[list]:
        model, out = pieces(model_path), []
        coded = model.encode_all([t or "" for t in texts], keys if dropout > 0 else [None] * len(keys), dropout)
        for t, (ids, skipped) in zip(texts, coded, strict=True):
            out.append((len(ids), skipped, zlib.crc32(ids.tobytes()), model.decode(ids) == (t or "")))
        return [list(c) for c in zip(*out, strict=True)] or [[]] * 4

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(seed)).alias("_key"))
    return add_columns(keyed, ["_key", "text"], run, "n_pieces long, n_skipped long, ids_crc32 long, lossless boolean", drop=("_key", "text"))
