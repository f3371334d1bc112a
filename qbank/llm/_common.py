"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that Arrow hands to Python at once. Whole texts travel, so the default of 10,000 rows is too many.
ROWS_PER_BATCH = 256

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space; bytes of 0x80 and more stay.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)

#: 1 for bytes that belong to a word.
IS_WORD = np.array([b != 0x20 for b in WORD_BYTES], dtype=bool)


def words(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return data.translate(WORD_BYTES).split()


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bounds what one Arrow batch of whole texts can hold. Spark has this as a setting of the session only; README names it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def add_columns(df: DataFrame, inputs: list[str], fn: Callable, ddl: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """df with columns that fn makes of the input columns, batch by batch: fn(list, ...) -> list of columns, in the order of ddl.

    All other columns pass through Arrow untouched, whatever their type and nulls. drop names columns that do not pass; a column
    that has the name of a new one, in whatever case, is replaced.
    """
    small_batches(df.sparkSession)
    new = T._parse_datatype_string(ddl)
    replaced = {n.lower() for n in (*drop, *new.names)}
    kept = [f for f in df.schema.fields if f.name.lower() not in replaced]
    names, kinds = [f.name for f in kept], [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = fn(*(b.column(c).to_pylist() for c in inputs))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in names] + [c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(made, kinds, strict=True)],
                names=[*names, *new.names],
            )

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def expand_rows(df: DataFrame, keep: list[str], inputs: list[str], fn: Callable, ddl: str) -> DataFrame:
    """Any number of rows for each row: fn(list, ...) -> (row number of each new row, list of its columns)."""
    small_batches(df.sparkSession)
    new = T._parse_datatype_string(ddl)
    kept = [df.schema[c] for c in keep]
    kinds = [f.type for f in to_arrow_schema(new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, made = fn(*(b.column(c).to_pylist() for c in inputs))
            rows = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(rows) for c in keep] + [c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(made, kinds, strict=True)],
                names=[*keep, *new.names],
            )

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))


def over_runs(df: DataFrame, keys: list[str], order: list[str], fn: Callable, ddl: str, parts: int, rows: int = 4096) -> DataFrame:
    """Applies fn to the rows of df dealt by keys and sorted by keys and order: fn(pa.Table of whole runs) -> list of columns.

    A run holds all rows of equal keys (longs); many runs come in one call, so short ones cost no call of their own. What a task
    holds at once is `rows` rows and one run.
    """
    new = T._parse_datatype_string(ddl)
    kinds = [f.type for f in to_arrow_schema(new)]

    def made(table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(fn(table), kinds, strict=True)], names=list(new.names)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, rows
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= limit:
                table = pa.Table.from_batches(held)
                if last := int(run_bounds(table, keys)[-2]):
                    yield made(table.slice(0, last))
                held, n = table.slice(last).to_batches(), n - last
                limit = max(rows, 2 * n)
        if n:
            yield made(pa.Table.from_batches(held))

    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, new)


def run_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin, and the end of the table."""
    change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
    for k in keys:
        v = table.column(k).to_numpy()
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, local mode gets one of its own (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/qbank-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there and any executor can reread it.

    The tables of an application stay in a folder of its own until drop_tables, or until whoever looks after the shared folder
    removes it: results that are not yet written may read them.
    """
    return _cut(df)[0]


def _cut(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(spark: SparkSession) -> None:
    """Removes what cut has written in this application; call it once all results are written."""
    _remove(spark, shared_folder(spark))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (node, component), where component is the least node.

    Alternating large-star and small-star steps; every round is written to the shared folder, so a round never
    depends on more than the one before it. Nodes without an edge do not appear. Nothing is collected but a checksum.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    (e, path), seen = _cut(e), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = path
        e, path = _cut(rest.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(low).distinct())
        _remove(e.sparkSession, before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


class Forest:
    """Union-find over 0..n-1 inside one block; roots are the least members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds the edges a[i]-b[i], by repeated hooking to the lesser root and pointer jumping."""
        while len(a):
            ra, rb = self.up[a], self.up[b]
            if (open_ := ra != rb).sum() == 0:
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
            while (nxt := self.up[self.up]).tolist() != self.up.tolist():
                self.up = nxt


# A polynomial over bytes modulo 2**64. BASE is odd and so has an inverse; a window's value does not depend on its place.
_RNG = np.random.default_rng(20240613)
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(2**40, 2**62)) * 8 + 5
INVERSE = pow(BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 12
        have = np.ones(size, dtype=np.uint64)
        have[1:] = base % 2**64
        np.multiply.accumulate(have, out=have)
        if size > 1 << 22:  # not kept: one very long text shall not fill the worker's memory for good
            return have[:n]
        _POWERS[base] = have
    return have[:n]


def prefix_values(data: np.ndarray) -> np.ndarray:
    """Running polynomial of the bytes, with a leading 0."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def window_values(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit values of the windows [start, end)."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values (splitmix64, public domain)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
