"""Approximate nearest neighbours by multiprobe p-stable hashing, with an exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, shuffle_parts
from .near_dup_vectors import usable

#: Hash tables; cells of a hash function (the outer two are open); rows of a bucket on average; hash functions at most.
TABLES, CELLS, PER_BUCKET, FUNCTIONS = 2, 3, 600, 7
#: Queries on which the number of probes is calibrated, and the share of their true neighbours that it must reach.
CALIBRATION, RECALL = 128, 0.97
#: Buckets of each table that a query visits first; the score of its k-th best there bounds what later visits return.
FIRST = 3
#: Chance that the buckets which a query visits of one table hold a neighbour as far off as its k-th best so far.
COVERED = 0.95
#: Rows of a bucket, or queries that visit it, that meet in one block at most.
BLOCK = 2048


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x)
    return np.sign(x) * y


class Hashes:
    """TABLES tables of p-stable (Gaussian) hash functions floor((a.x + b) / w) over vectors, with the outer cells open.

    Inner products are searched through distances: each vector gets one more component that brings its norm to the greatest one,
    queries get 0 there, and then the nearest vector has the largest product.
    """

    def __init__(self, dim: int, top: float, functions: int, spread: np.ndarray | None = None, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim, self.top, self.functions = dim, top, functions
        self.a = rng.normal(size=(TABLES, dim + 1, functions))
        scale = np.std(spread @ self.a, axis=1) if spread is not None and len(spread) > 1 else np.full((TABLES, functions), top)
        middle = np.mean(spread @ self.a, axis=1) if spread is not None and len(spread) else np.zeros((TABLES, functions))
        #: The width puts about as many rows into the middle cell as into each open one.
        self.width = np.maximum(scale, 1e-9) * 0.86
        self.shift = -middle + self.width * (CELLS / 2) + self.width * (rng.random((TABLES, functions)) - 0.5) * 0.2
        self.places = CELLS ** np.arange(functions)
        self.digits = np.arange(CELLS**functions)[:, None] // self.places % CELLS

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        own = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.hstack([x, own[:, None]])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        f = (self.lift(x, False) @ self.a + self.shift[:, None]) / self.width[:, None]
        return (np.clip(np.floor(f), 0, CELLS - 1).astype(np.int64) @ self.places).T

    def order(self, x: np.ndarray, filled: list[np.ndarray], reach: np.ndarray | float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table and query, its filled buckets in falling estimated success, and how many of them are worth a visit.

        The difference of a neighbour's projection from the query's is Gaussian with deviation reach times |a| = reach here, one for
        all queries or one for each; a bucket's success is the product over the functions of the chance of falling into its cells.
        Worth a visit are as many as hold a neighbour with chance COVERED.
        """
        reach = np.broadcast_to(np.asarray(reach, dtype=float), (len(x),))[:, None, None]
        f = self.lift(x, True) @ self.a + self.shift[:, None]
        out = []
        for t in range(TABLES):
            edges = np.concatenate([[-np.inf], np.arange(1, CELLS), [np.inf]])[None, :, None] * self.width[t][None, None]
            edges = np.where(np.isnan(edges), 0, edges)
            below = 0.5 * (1 + _erf(np.clip((edges - f[t][:, None]) / (np.maximum(reach, 1e-12) * math.sqrt(2)), -8, 8)))
            chance = np.log(np.maximum(np.diff(below, axis=1), 1e-12))  # query, cell, function
            score = sum(chance[:, self.digits[filled[t], j], j] for j in range(self.functions))
            by = np.argsort(-score, axis=1, kind="stable")
            held = np.cumsum(np.exp(np.take_along_axis(score, by, axis=1)), axis=1)
            out.append((filled[t][by], (held < COVERED).sum(axis=1) + 1))
        return out


def _best(q_ids, q, x_ids, x, k: int) -> pd.DataFrame:
    """The k best rows of x for each query, by the exact inner product and then the smaller id."""
    parts = []
    for s in range(0, len(q), 256):
        rough = q[s : s + 256] @ x.T
        own = q_ids[s : s + 256, None] == x_ids[None]
        rough[own] = -np.inf
        if x.shape[0] > k:
            least = np.partition(rough, -k, axis=1)[:, -k]
            keep = rough >= (least - 1e-9 * (1 + np.abs(least)))[:, None]
        else:
            keep = np.ones_like(own)
        i, j = np.nonzero(keep & ~own)
        score = (q[s + i] * x[j]).sum(axis=1)
        order = np.lexsort((x_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < k
        parts.append(pd.DataFrame({"query_id": q_ids[s + i[top]], "vec_id": x_ids[j[top]], "score": score[top]}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


_FOUND = "query_id long, vec_id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of vectors for each row of queries, by inner product.

    Both need vec_id (long, unique) and embedding (array<float>). A query's own vec_id is no candidate. Ties go to the smaller
    vec_id; with fewer candidates all are returned. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those with a null vec_id; vectors shorter than the longest count as padded with zeros.

    Every row is hashed into TABLES tables. A query visits the filled buckets in the order of their estimated success, as many
    as a calibration needs: CALIBRATION of the queries are answered by brute force over all rows, and the number of probes is
    raised until `recall` of their true neighbours lie in a visited bucket. These are the fewest: a query goes on until its buckets
    hold what is as near as its own k-th best so far with chance COVERED in each table, and one that has not found k rows goes
    through all buckets; so a query among few neighbours is not cut short by the others. Rows and visits of a bucket meet in blocks of
    bounded size, each block returns its k best for each query with exact scores, and the best k of all stay. The first
    visits of each query give a score that its k-th best reaches at least, and later blocks return nothing below it.
    """
    ok = F.expr(f"vec_id IS NOT NULL AND {usable('embedding')}")
    base = vectors.select("vec_id", "embedding").where(ok)
    asked = queries.select("vec_id", "embedding").where(ok)
    norm = F.expr("sqrt(aggregate(embedding, 0D, (s, x) -> s + double(x) * double(x)))")
    total, dim, top = base.agg(F.count("*"), F.max(F.size("embedding")), F.max(norm)).first()
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = asked.agg(F.max(F.size("embedding"))).first()[0] or 0
    dim = max(dim, longest)

    def matrix(column) -> np.ndarray:
        x = np.zeros((len(column), dim))
        for i, v in enumerate(column):
            x[i, : len(v)] = v
        return x

    def sampled(df: DataFrame, n: int):
        rows = df.orderBy(F.xxhash64("vec_id", F.lit(9))).limit(n).collect()
        return np.array([r["vec_id"] for r in rows], dtype=np.int64), matrix([r["embedding"] for r in rows])

    functions = int(min(FUNCTIONS, max(1, round(math.log(max(1, total / PER_BUCKET), CELLS)))))
    plain = Hashes(dim, top, functions)
    hashes = Hashes(dim, top, functions, plain.lift(sampled(base, 2048)[1], False))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = hashes.buckets(matrix(b["embedding"]))
            yield pd.concat([pd.DataFrame({"vec_id": b["vec_id"], "embedding": b["embedding"], "tbl": t, "bucket": own[:, t]}) for t in range(TABLES)])

    placed = cut(base.mapInPandas(deal, "vec_id long, embedding array<float>, tbl int, bucket long"))
    # At most TABLES * CELLS ** FUNCTIONS rows.
    sizes = placed.groupBy("tbl", "bucket").count().collect()
    filled = [np.array(sorted(r["bucket"] for r in sizes if r["tbl"] == t), dtype=np.int64) for t in range(TABLES)]

    some_ids, some = sampled(asked, CALIBRATION)
    if not len(some_ids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _best(some_ids, some, b["vec_id"].to_numpy(), matrix(b["embedding"]), k)

    true = _top(base.mapInPandas(brute, _FOUND), k)
    where = true.join(placed.select("vec_id", "tbl", "bucket"), "vec_id").select("query_id", "rank", "score", "tbl", "bucket").collect()
    reach = 1.0
    if where:  # how far the last true neighbours are, after lifting
        last = [top * top + float(x @ x) - 2 * r["score"] for r in where if r["rank"] >= k // 2 for x in [some[np.flatnonzero(some_ids == r["query_id"])[0]]]]
        reach = math.sqrt(max(1e-12, float(np.median(last)) if last else 1.0))
    orders = hashes.order(some, filled, reach)
    spot = {int(q): i for i, q in enumerate(some_ids)}
    first: dict[tuple[int, int], int] = {}
    for r in where:
        at = int(np.flatnonzero(orders[r["tbl"]][0][spot[r["query_id"]]] == r["bucket"])[0])
        key = (r["query_id"], r["rank"])
        first[key] = min(first.get(key, 1 << 30), at)
    probes = max(map(len, filled))
    if first:
        ranks = np.sort(list(first.values()))
        probes = int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first buckets of each query, or, where it has a least score, those that this makes worth a visit, `probes` at least;
        a query that has not found k rows yet (its least score is minus infinity) visits all."""
        for b in batches:
            for s in range(0, len(b), 64):
                part = b.iloc[s : s + 64]
                x, least, late = matrix(part["embedding"]), part["least"].to_numpy(dtype=float), bool(part["late"].iloc[0])
                far = np.sqrt(np.maximum(top * top + (x * x).sum(axis=1) - 2 * least, 1e-12)) if late else reach
                for t, (own, worth) in enumerate(hashes.order(x, filled, np.where(np.isfinite(far), far, 2 * top) if late else reach)):
                    take = np.where(np.isneginf(least), own.shape[1], np.maximum(worth, probes)) if late else np.full(len(own), FIRST)
                    take = np.minimum(take, own.shape[1])
                    row = np.repeat(np.arange(len(own)), take)
                    at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
                    yield pd.DataFrame({"tbl": t, "bucket": own[row, at], "vec_id": part["vec_id"].to_numpy()[row], "embedding": part["embedding"].to_numpy()[row], "least": least[row]})

    def visits(some: DataFrame, late: bool) -> DataFrame:
        # Dealt anew, as ordering the buckets is much work for few bytes and would else be put together into few tasks.
        return some.withColumn("late", F.lit(late)).repartition(shuffle_parts(spark), "vec_id").mapInPandas(visit, "tbl int, bucket long, vec_id long, embedding array<float>, least double")

    key = ["tbl", "bucket"]
    held = placed.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ms"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        found = _best(q["vec_id"].to_numpy(), matrix(q["embedding"]), x["vec_id"].to_numpy(), matrix(x["embedding"]), k)
        least = dict(zip(q["vec_id"].tolist(), q["least"].tolist(), strict=True))
        return found[found["score"] >= found["query_id"].map(least)]

    def answer(some: DataFrame) -> DataFrame:
        """What the visits of `some` find, at least as good as their column least."""
        counts = cut(some.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs"))).join(held, key)
        rows = placed.join(counts, key).select(
            *key, F.pmod(F.xxhash64("vec_id"), F.col("ms")).cast("int").alias("i"), F.explode(F.expr("sequence(0, qs - 1)")).alias("j"), "vec_id", "embedding",
            F.lit(None).cast("double").alias("least"), F.lit(False).alias("asks"),
        )
        asks = some.join(counts, key).select(
            *key, F.explode(F.expr("sequence(0, ms - 1)")).alias("i"), F.pmod(F.xxhash64("vec_id", F.lit(4)), F.col("qs")).cast("int").alias("j"), "vec_id", "embedding",
            "least", F.lit(True).alias("asks"),
        )
        return rows.union(asks).repartition(shuffle_parts(spark), *key, "i", "j").groupBy(*key, "i", "j").applyInPandas(block, _FOUND)

    none = F.lit(float("-inf"))
    early = cut(_top(answer(visits(asked.withColumn("least", none), False)), k))
    least = early.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    late = answer(visits(asked.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", none)), True))
    return _top(early.select("query_id", "vec_id", "score").union(late), k)
