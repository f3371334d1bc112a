"""Similarity of vectors: an exact index and top-k by cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a tile, and queries whose products with a tile's rows are held at once.
BLOCK, STRIP = 4096, 256


def index(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1, in double precision; zero vectors stay zero."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("norm", norm).withColumn(
        "unit", F.transform("embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("norm")), F.lit(0.0)))
    )


def _nearest(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of x for each query (and ties with the last of them): query, row and score, by one product of matrices for
    each strip of queries. Products choose the candidates, with some room; scores are then summed entry by entry."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), STRIP):
        rough = q[s : s + STRIP] @ x.T
        rough[q_ids[s : s + STRIP, None] == x_ids[None]] = -np.inf
        if len(x) > k:
            least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - 1e-9
        else:
            least = np.full(len(rough), -2.0)
        i, j = np.nonzero((rough >= least[:, None]) & np.isfinite(rough))
        found.append((q_ids[s + i], x_ids[j], (q[s + i] * x[j]).sum(axis=1)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def similar(indexed: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.6, block: int = BLOCK) -> DataFrame:
    """The k rows of greatest cosine for each query, then those of at least `threshold`; ties to the smaller id.

    Every query meets every row, in tiles of about `block` queries and `block` rows, whatever the size of the tables; a tile
    leaves its k best of each query. So neither side is broadcast, a task holds one tile, and a row travels once for each block
    of queries. Exact, as is asked for: the work is the product of both counts. Vectors of one length, as index gives them.
    """
    rows, asks = (max(1, -(-df.count() // block)) for df in (indexed, queries))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("vec_id", "unit", deal(asks).alias("b"), every(rows).alias("p"))
    x = indexed.select("vec_id", "unit", every(asks).alias("b"), deal(rows).alias("p"))

    def parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("vec_id").to_numpy()
        return ids, t.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.empty((0, 0))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        return pa.table(dict(zip(("query_id", "vec_id", "score"), _nearest(*parts(a), *parts(b), k), strict=True)))

    found = q.groupBy("b", "p").cogroup(x.groupBy("b", "p")).applyInArrow(best, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("score") >= threshold))


def missing(items: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What the cache does not hold yet."""
    return items.join(cache.select(key).distinct(), key, "left_anti")
