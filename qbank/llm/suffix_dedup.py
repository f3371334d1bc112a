"""Removal of long byte strings that occur more than once in a corpus, by blockwise suffix sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import add_columns, cut, expand_rows, over_runs, prefix_values, run_bounds, shuffle_parts, window_values, words

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes by which suffixes are put into buckets, at the sample positions of the cover.
HEAD = 64
#: Spans of a bucket; larger buckets are dealt out again by SPLIT windows at a time, those of over 64 times as many by single ones.
BUCKET, SPLIT = 4096, 32
#: A passage, for which shorter strings count: bytes of a repeated string, and words of what such strings cover together.
PASSAGE, PASSAGE_WORDS = 200, 50


def cover(prefix: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cover samples of a text: for each, its place, its bucket (value of its HEAD bytes), first and last window start.

    The sample is content-synchronised: of each `gap` successive HEAD-byte strings the one of least value is taken, the
    leftmost if several are least. It does for equal strings of `length` bytes what a difference cover does for all pairs of
    suffixes (both have a sample at the same offset), with about 2 / gap of all positions where an arithmetic difference cover
    takes ten times as many. Every window of `length` bytes belongs to the one sample that is chosen for it.
    """
    n, gap = len(prefix) - 1 - length + 1, length - HEAD + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 4
    at = np.arange(n + gap - 1)
    value = window_values(prefix, at, at + HEAD)
    # The place in the low bits, so that the least key names its place, and of equal values the leftmost is least.
    key = (value & ~_PLACE) | at.astype(np.uint64)
    # Sliding minimum over gap keys, from running minima of blocks of that size in both directions.
    blocks = np.concatenate([key, np.full(-len(key) % gap, 2**64 - 1, dtype=np.uint64)]).reshape(-1, gap)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(back[:n], ahead[gap - 1 : gap - 1 + n]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    place = chosen[first]
    return place, value[place], first, np.append(first[1:], n) - 1


_PLACE = np.uint64(2**31 - 1)


def _samples(lengths: tuple[int, ...]):
    """For each text its distinct spans, each the bytes of all windows of one sample: bucket, value, windows, lead, bytes, starts."""
    least, most = min(lengths), max(lengths)

    def run(texts: list) -> tuple[np.ndarray, list]:
        rows, heads, values, windows, leads, widths, starts, ends = [[np.zeros(0, dtype=np.int64)] for _ in range(8)]
        total = 0
        for i, text in enumerate(texts):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            if len(data) < least:
                continue
            prefix = prefix_values(data)
            place, head, first, last = cover(prefix, least)
            end = np.minimum(last + most, len(data))
            span = window_values(prefix, first, end) + (place - first).astype(np.uint64)
            order = np.lexsort((span, head))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(span[order]) != 0) | (np.diff(head[order]) != 0)]))
            pick = order[new]
            rows.append(np.full(len(pick), i)), heads.append(head[pick].view(np.int64)), values.append(span[pick].view(np.int64))
            windows.append((last - first + 1)[pick]), leads.append((place - first)[pick]), widths.append((end - first)[pick])
            starts.append(first[order]), ends.append(np.append(new[1:], len(order)) + total)
            total += len(order)
        join = lambda parts, kind: np.concatenate(parts).astype(kind)
        lists = pa.ListArray.from_arrays(pa.array(join([[0], *ends], np.int32)), pa.array(join(starts, np.int32)))
        return join(rows, np.int64), [join(heads, np.int64), join(values, np.int64), *(join(x, np.int32) for x in (windows, leads, widths)), lists]

    return run


def _pack(texts: list) -> list[list]:
    """Texts as compressed bytes, for the shuffle that carries them."""
    squeeze = zstandard.ZstdCompressor(level=1)
    return [[squeeze.compress((t or "").encode()) for t in texts]]


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _cut_spans(lengths: tuple[int, ...]):
    """The bytes of the wanted spans of each text, in pieces where their bucket is dealt out again (step > 0).

    A piece has the windows that begin k * step to (k + 1) * step - 1 bytes before the sample. Its bucket is the value of the bytes
    that all these windows hold, so what can be equal meets, and its sample is where these bytes begin.
    """
    least, most = min(lengths), max(lengths)

    def run(texts: list, spans: list) -> tuple[list, list]:
        buckets, heads, values, pieces, begins, windows, leads, single, data, steps = [], [], [], [], [], [], [], [], [], []
        for text, own in zip(texts, spans, strict=True):
            whole = _unpack(text)
            for x in own:
                got, step = whole[x["start"] : x["start"] + x["width"]], max(0, x["step"])
                edges = [0, x["windows"]]
                if step:
                    edges = [0, *range((x["lead"] + 1) % step or step, x["windows"], step), x["windows"]]
                    prefix = prefix_values(np.frombuffer(got, dtype=np.uint8))
                    value = lambda i, j: int(window_values(prefix, np.array([i]), np.array([j])).view(np.int64)[0])  # noqa: B023, E731
                for f, e in zip(edges, edges[1:]):
                    at, end = x["lead"], len(got)
                    bucket, piece = x["head"], x["span"]
                    if step:
                        k = (at - f) // step
                        at, end = at - k * step, min(e - 1 + most, end)
                        bucket = hash((bucket, k, value(at, at - step + 1 + least)))
                        piece = value(f, end)
                    buckets.append(bucket), heads.append(x["head"]), values.append(x["span"]), pieces.append(piece), begins.append(f)
                    windows.append(e - f), leads.append(at - f), single.append(x["single"]), data.append(got[f:end]), steps.append(x["step"])
        return [0] * len(heads), [steps, buckets, heads, values, pieces, begins, windows, leads, single, data]

    return run


_CUT = "bucket long, head long, span long, piece long, begin int, windows int, lead int, single boolean, bytes binary"


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of small whole numbers, the first the most significant."""
    key = keys[0].astype(np.int64)
    for k in keys[1:]:
        key = key * (int(k.max(initial=0)) + 1) + k
    return np.unique(key, return_inverse=True)[1]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and end column of each run of True in the rows of a matrix."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def _sort_buckets(lengths: tuple[int, ...]):
    """Sorts the suffixes of whole buckets and gives the runs of suffixes that tie with another over each length.

    First the suffixes at the samples are ranked by their bytes, at every depth. Each suffix before its sample is then ranked by
    the bytes up to the sample, taken byte by byte backwards, and ties by the sample's rank at the depth that is left. Equal
    ranks are equal bytes: no hash is compared here.
    """
    most = max(lengths)

    def run(table: pa.Table) -> list:
        span = table.column("bytes").to_pylist()
        lead, begin, windows = (table.column(c).to_numpy().astype(np.int64) for c in ("lead", "begin", "windows"))
        size = np.array([len(s) for s in span], dtype=np.int64)
        n, back = len(span), int(lead.max())
        # Spans side by side with their samples in one column; 256 where a span has no byte.
        wide = max(back + int((size - lead).max()), back + 1)
        column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(back - lead, size)
        grid = np.full((wide, n), 256, dtype=np.int16)
        grid[column, np.repeat(np.arange(n), size)] = np.frombuffer(b"".join(span), dtype=np.uint8)
        bounds = run_bounds(table, ["bucket"])
        after = [np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))]  # after[q]: ranks of the q bytes from the sample on
        for q in range(min(most, wide - back)):
            after.append(_ranks(after[-1], grid[back + q]))
        before, flags = np.zeros(n, dtype=np.int64), {x: np.zeros((n, back + 1), dtype=bool) for x in lengths}
        for p in range(back + 1):
            if p:
                before = _ranks(grid[back - p], before)
            for x in lengths:
                if 0 <= x - p < len(after):
                    fits = np.flatnonzero((p <= lead) & (lead - p < windows) & (size - lead + p >= x))
                    which = _ranks(before[fits], after[x - p][fits])
                    flags[x][fits, back - p] = np.bincount(which)[which] > 1
        single, out = table.column("single").to_numpy(zero_copy_only=False), [[] for _ in range(4)]
        for x in lengths:
            row, first, end = _runs(flags[x] & single[:, None])
            shift = lead[row] - back + begin[row]
            out[0].append(row), out[1].append(np.full(len(row), x)), out[2].append(first + shift), out[3].append(end + shift)
        row, length, first, end = (np.concatenate(o) for o in out)
        return [table.column("head").to_numpy()[row], table.column("span").to_numpy()[row], length, first, end]

    return run


_HIT = "head long, span long, length int, first int, end int"


def _list_windows(lengths: tuple[int, ...]):
    """Every window of a span, with its value."""

    def run(windows: list, spans: list) -> tuple[np.ndarray, list]:
        rows, size, at, values = [], [], [], []
        for i, (n, data) in enumerate(zip(windows, spans, strict=True)):
            prefix = prefix_values(np.frombuffer(data, dtype=np.uint8))
            for x in lengths:
                start = np.arange(min(n, len(data) - x + 1))
                rows.append(np.full(len(start), i)), size.append(np.full(len(start), x)), at.append(start)
                values.append(window_values(prefix, start, start + x).view(np.int64))
        join = lambda parts, kind: np.concatenate([np.zeros(0, dtype=kind), *parts]).astype(kind)
        return join(rows, np.int64), [join(size, np.int32), join(at, np.int32), join(values, np.int64)]

    return run


def _covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    flags = np.zeros(n + 1, dtype=np.int32)
    np.add.at(flags, first, 1)
    np.add.at(flags, end, -1)
    return np.cumsum(flags[:-1]) > 0


def _strip(*rules: tuple[int, int]):
    """Texts without the runs that ranges of a length cover, if a run has so many words at the least; rules are (length, words)."""

    def run(texts: list, ranges: list) -> list[list]:
        rest, total, gone, runs = [], [], [], []
        for text, own in zip(texts, ranges, strict=True):
            data = (text or "").encode()
            total.append(len(data))
            held = []
            size, first, end = np.array(own or [], dtype=np.int64).reshape(-1, 3).T
            for length, fewest in rules:
                if (mine := size == length).any():
                    found = _islands(_covered(len(data), first[mine], end[mine]))
                    held += [(f, e) for f, e in found if not fewest or len(words(data[f:e])) >= fewest]
            if len(rules) > 1 and held:
                held = _islands(_covered(len(data), *np.array(held).T))
            outside = [0, *(x for pair in held for x in pair), len(data)]
            rest.append(b"".join(data[f:e] for f, e in zip(outside[::2], outside[1::2], strict=True)))
            gone.append(sum(e - f for f, e in held)), runs.append(len(held))
        return [rest, total, gone, runs]

    return run


def _islands(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def repeated_ranges(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """Rows (doc_id, body, ranges) for the texts that hold strings of these lengths that also start elsewhere.

    ranges are numbers, three for each range: length, start and end. body tells texts of one doc_id apart. Ranges may overlap;
    their union is what such strings cover.
    """
    spark, least = docs.sparkSession, min(lengths)
    parts = shuffle_parts(spark)
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), "text")
    samples = expand_rows(
        keyed, ["doc_id", "body"], ["text"], _samples(lengths), "head long, span long, windows int, lead int, width int, starts array<int>"
    )
    samples = cut(samples.withColumn("ref", F.monotonically_increasing_id()))
    # Distinct spans, counted before anything else moves. A bucket with a single place holds nothing repeated.
    bucket = Window.partitionBy("head")
    spans = samples.groupBy("head", "span").agg(F.sum(F.size("starts")).alias("places"), F.min("ref").alias("one")).select(
        "*", F.count("*").over(bucket).alias("kinds"), F.min("places").over(bucket).alias("fewest"), F.sum("places").over(bucket).alias("m")
    ).where("m > 1")
    # Spans that occur twice are repeated as a whole; the others need a look at the suffixes they share in part.
    step = F.when(F.col("kinds") <= BUCKET, 0).when(F.col("kinds") <= 64 * BUCKET, SPLIT).otherwise(-1)
    spans = spans.select("head", "span", "one", (F.col("places") == 1).alias("single"), F.when(F.expr("kinds > 1 and fewest = 1"), step).alias("step"))
    met = cut(samples.join(spans, ["head", "span"]).select("*", (F.col("ref") == F.col("one")).alias("stands")).drop("ref", "one"))
    wanted = met.where("stands and step is not null").select(
        "doc_id", "body", F.struct("head", "span", "windows", "lead", "width", F.col("starts")[0].alias("start"), "single", "step").alias("x")
    )
    per_text = wanted.groupBy("doc_id", "body").agg(F.collect_list("x").alias("spans"))
    found = add_columns(keyed, ["text"], _pack, "text binary").join(
        per_text.select(F.col("doc_id").alias("d"), F.col("body").alias("b"), "spans").hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")),
    )
    cutout = cut(expand_rows(found.select("text", "spans"), [], ["text", "spans"], _cut_spans(lengths), f"step int, {_CUT}"))
    sort = lambda df, n: over_runs(df, ["bucket"], ["span", "begin"], _sort_buckets(lengths), _HIT, max(parts, n // 20_000))
    hit = sort(cutout.where("step = 0"), cutout.count())
    # Pieces of big buckets: those that occur more than once are repeated as a whole and stand in the bucket once.
    split = cutout.where("step > 0")
    if split.limit(1).count():
        counted = split.groupBy("bucket", "piece").agg(F.count("*").alias("m"), F.min(F.struct("head", "span", "begin")).alias("one"))
        split = cut(split.join(counted, ["bucket", "piece"]))
        stand = split.where("m = 1 OR struct(head, span, begin) = one")
        fitting = F.least("windows", F.length("bytes") - F.col("length") + 1).cast("int")
        whole = split.where("single AND m > 1").withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths]))).where(fitting > 0)
        hit = hit.union(sort(stand.withColumn("single", F.expr("single AND m = 1")).drop("m", "one"), stand.count()))
        hit = hit.union(whole.select("head", "span", "length", F.col("begin").alias("first"), (F.col("begin") + fitting).alias("end")))
    # Buckets too big even for that: their windows are counted by their values.
    listed = expand_rows(cutout.where("step < 0"), ["head", "span", "single"], ["windows", "bytes"], _list_windows(lengths), "length int, first int, value long")
    ties = listed.groupBy("head", "length", "value").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    hit = hit.union(listed.where("single").join(ties, ["head", "length", "value"]).select("head", "span", "length", "first", F.col("first") + 1))
    # A span that is repeated as a whole needs no join: its windows are all hit, as far as the length fits into it.
    fits = lambda x: F.least("windows", F.col("width") - x + 1)
    whole = met.where("not single").withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
    whole = whole.select("doc_id", "body", "starts", "length", F.lit(0).alias("first"), fits(F.col("length")).alias("end")).where("end > 0")
    partly = met.where("single").select("doc_id", "body", "head", "span", "starts").join(hit, ["head", "span"])
    ranges = whole.union(partly.select(*whole.columns)).select(
        "doc_id", "body", F.expr("flatten(transform(starts, s -> array(length, s + first, s + end + length - 1)))").alias("ranges")
    )
    return ranges.groupBy("doc_id", "body").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def _with_ranges(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    ranges = cut(repeated_ranges(docs, lengths))
    body = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    ranges = ranges.select(F.col("doc_id").alias(_D), F.col("body").alias(_B), F.col("ranges").alias(_RANGES))
    return docs.join(ranges.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(ranges[_D]) & (body == ranges[_B]), "left").drop(_D, _B)


_D, _B, _RANGES = "__repeats_doc_id", "__repeats_body", "__repeats_ranges"
_STRIPPED = "kept binary, n_bytes long, n_removed long, n_spans long"


def remove_repeats(docs: DataFrame, length: int = LENGTH, passages: bool = False) -> DataFrame:
    """Documents without the byte strings of `length` bytes that also start elsewhere in the corpus, the same text included.

    docs needs doc_id and text. Every column is kept; added are kept (the remaining bytes), n_bytes, n_removed and n_spans
    (maximal removed runs). With passages, n_passages counts the runs of 50 words and more that repeated strings of 200 bytes
    cover; these stay in the text. Texts are UTF-8 bytes, null is empty, matches do not cross texts, and strings are judged on
    the input. Rows are told apart by doc_id and text, so repeated rows remove each other's text and a null doc_id is no special
    case. Texts shorter than a string stay as they are. A column of docs that has the name of a new one is replaced.

    Blockwise suffix sorting with a cover: each text gives its cover samples, the suffixes are dealt into buckets by their
    first 64 bytes at the sample, buckets with one place are dropped, and the others are sorted, some whole buckets at a time; long
    ties are settled by the samples' ranks. Spans that agree as a whole are sorted once. A bucket of many spans is dealt out again
    by what shorter stretches of its suffixes have in common.
    """
    lengths = (length, PASSAGE) if passages else (length,)
    found = _with_ranges(docs, lengths)
    strip, count = _strip((length, 0)), _strip((PASSAGE, PASSAGE_WORDS))

    def both(texts: list, ranges: list) -> list[list]:
        return strip(texts, ranges) + ([count(texts, ranges)[3]] if passages else [])

    return add_columns(found, ["text", _RANGES], both, _STRIPPED + (", n_passages long" if passages else ""), drop=(_RANGES,))


def remove_passages(docs: DataFrame) -> DataFrame:
    """As remove_repeats, but takes out passages too: runs of 50 words and more, covered by strings of 200 bytes that start elsewhere."""
    both = _strip((LENGTH, 0), (PASSAGE, PASSAGE_WORDS))
    return add_columns(_with_ranges(docs, (LENGTH, PASSAGE)), ["text", _RANGES], both, _STRIPPED, drop=(_RANGES,))


def without_passages(docs: DataFrame) -> DataFrame:
    """docs with what remove_passages keeps as text, a character cut in two gone as a whole; a null text stays null.

    Both in one call of Python: a second one would take a second worker for every task, each with memory of its own.
    """
    strip = _strip((LENGTH, 0), (PASSAGE, PASSAGE_WORDS))

    def run(texts: list, ranges: list) -> list[list]:
        return [[None if t is None else k.decode("utf-8", "ignore") for k, t in zip(strip(texts, ranges)[0], texts, strict=True)]]

    return add_columns(_with_ranges(docs, (LENGTH, PASSAGE)), ["text", _RANGES], run, "text string", drop=(_RANGES,))


def sha256_hex(kept) -> str:
    return hashlib.sha256(kept).hexdigest()
