"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Forest, components, cut, shuffle_parts

COSINE = 0.98
#: Vectors on which the quantiser is trained at most, vectors for each inverted list on average, and lists at most.
SAMPLE, PER_LIST, LISTS = 4096, 1600, 1024
#: Subspaces of a residual, and centroids of each.
SUBSPACES, CODES = 8, 32
#: Members of a list, or vectors that probe it, that meet in one block at most.
BLOCK = 2048
_EPS = 1e-6


def usable(column: str) -> str:
    """SQL condition: not null, not zero, and every component a finite number."""
    return (
        f"{column} IS NOT NULL AND forall({column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
        f"AND exists({column}, x -> x <> 0)"
    )


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = _distances(x, at).argmin(axis=1)
        for j in range(len(at)):
            if (own := near == j).any():
                at[j] = x[own].mean(axis=0)
    return at


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


class Quantiser:
    """Coarse centroids and residual codebooks for unit vectors, padded with zeros to one dimension."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.coarse = kmeans(sample, lists, seed=5)
        rest = sample - self.coarse[_distances(sample, self.coarse).argmin(axis=1)]
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES, seed=7 + a) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.gap = np.sqrt(_distances(self.coarse, self.coarse))

    def home(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.coarse).argmin(axis=1)

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Lists that can hold a vector within radius of x: x is no further than that from their side of the bisecting plane."""
        d = _distances(x, self.coarse)
        near = d.argmin(axis=1)
        return d - d[np.arange(len(x)), near][:, None] <= 2 * (radius + _EPS) * self.gap[near] + _EPS

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each is from what its codes stand for."""
        codes = np.zeros((len(rest), len(self.books)), dtype=np.uint8)
        left = np.zeros(len(rest))
        for j, book in enumerate(self.books):
            d = _distances(rest[:, self.cuts[j] : self.cuts[j + 1]], book)
            codes[:, j] = d.argmin(axis=1)
            left += d.min(axis=1)
        return codes, np.sqrt(left)

    def lookup(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of residuals (exact) to codes, by one table for each subspace."""
        out = np.zeros((len(rest), len(codes)))
        for j, book in enumerate(self.books):
            out += _distances(rest[:, self.cuts[j] : self.cuts[j + 1]], book)[:, codes[:, j]]
        return np.sqrt(out)


def _unit(vectors, dim: int) -> np.ndarray:
    x = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Classes of vectors of one label whose cosine, in double precision, is at least `cosine`.

    vectors needs vec_id (long), embedding (array<float>) and label; other columns are ignored. Returns one row per input row:
    vec_id, n_links (other rows linked directly), component_id (least vec_id reachable, itself included), kept. A vector that is
    null, empty, zero or holds null or non-finite components, and one whose label or vec_id is null, links with nothing. Vectors
    of different lengths do not link. Rows that share a vec_id count each, and their links are joined under it.

    Equal vectors of one label become one node with a weight. Nodes are dealt into inverted lists; a node probes every list that
    can hold a vector near enough (the bisector test), so no link is lost to the lists. In a list, table-lookup distances less
    each code's own error rule out pairs that are surely too far; the rest are checked exactly. Blocks count links and emit one
    row for each node, never pairs. Blocks of long lists are at most BLOCK x BLOCK, so a large label or list is spread.
    """
    rows = vectors.select("vec_id", "embedding", "label").withColumn(
        "ok", F.expr(f"vec_id IS NOT NULL AND label IS NOT NULL AND {usable('embedding')}")
    ).withColumn("ok", F.coalesce("ok", F.lit(False)))
    nodes = cut(rows.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    total, dim = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not total:
        return alone.withColumn("kept", F.lit(True))
    share = min(1.0, 1.5 * SAMPLE / total)
    some = nodes.withColumn("h", F.xxhash64("node", F.lit(1)))
    some = some.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else some
    sample = [r["embedding"] for r in some.orderBy("h").limit(SAMPLE).select("embedding").collect()]
    q = Quantiser(_unit(sample, dim), int(min(LISTS, max(16, total // PER_LIST))))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _unit(list(b["embedding"]), dim)
            home = q.home(x)
            codes, left = q.encode(x - q.coarse[home])
            b["home"], b["left"] = home, left
            b["codes"] = [c.tobytes() for c in codes]
            b["probes"] = [np.flatnonzero(p).astype(np.int32) for p in q.probes(x, radius)]
            b["size"] = b["embedding"].map(len)
            yield b

    label = nodes.schema["label"].dataType.simpleString()
    placed = cut(nodes.mapInPandas(
        assign, f"label {label}, embedding array<float>, node long, n long, home int, left double, codes binary, probes array<int>, size int"
    ))
    probing = placed.select("label", "size", "node", "embedding", F.explode("probes").alias("list"))
    key = ["label", "size", "list"]
    held = placed.groupBy("label", "size", F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ms"))
    visits = probing.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs"))
    grid = held.join(visits, key)
    members = placed.withColumnRenamed("home", "list").join(grid, key).select(
        *key, F.pmod(F.xxhash64("node"), F.col("ms")).cast("int").alias("i"), F.explode(F.expr("sequence(0, qs - 1)")).alias("j"),
        "node", "embedding", "n", "codes", "left",
    )
    askers = probing.join(grid, key).select(
        *key, F.explode(F.expr("sequence(0, ms - 1)")).alias("i"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("qs")).cast("int").alias("j"),
        "node", "embedding", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left"),
    )

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["codes"].notna()
        m, a = pdf[own], pdf[~own]
        centre = q.coarse[int(pdf["list"].iloc[0])]
        raw_m, raw_a = np.array(list(m["embedding"]), dtype=np.float64), np.array(list(a["embedding"]), dtype=np.float64)
        if not len(m) or not len(a):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        norm_m, norm_a = np.sqrt((raw_m * raw_m).sum(1)), np.sqrt((raw_a * raw_a).sum(1))
        codes = np.frombuffer(b"".join(m["codes"]), dtype=np.uint8).reshape(len(m), -1)
        weight, left = m["n"].to_numpy(dtype=np.int64), m["left"].to_numpy()
        ids = np.concatenate([a["node"].to_numpy(), m["node"].to_numpy()])
        names, at = np.unique(ids, return_inverse=True)
        forest, links = Forest(len(names)), np.zeros(len(a), dtype=np.int64)
        unit_a = _unit(list(a["embedding"]), dim) - centre
        for s in range(0, len(a), 256):
            far = q.lookup(unit_a[s : s + 256], codes)
            i, j = np.nonzero(far - left[None] <= radius + 1e-4)
            for c in range(0, len(i), 200_000):
                x, y = i[c : c + 200_000] + s, j[c : c + 200_000]
                cos = np.einsum("ij,ij->i", raw_a[x], raw_m[y]) / (norm_a[x] * norm_m[y])
                ok = (cos >= cosine) & (at[x] != at[len(a) + y])
                np.add.at(links, x[ok], weight[y[ok]])
                forest.join_all(at[x[ok]], at[len(a) + y[ok]])
        out = pd.DataFrame({"node": a["node"].to_numpy(), "links": links, "root": names[forest.up[at[: len(a)]]]})
        return out[out["links"] > 0]

    # Dealt by the block itself: a union of sides that are dealt by `key` claims to be so too, but Spark 4.1.2 may then coalesce the
    # two sides differently, and a block would meet in two places.
    met = members.union(askers).repartition(shuffle_parts(vectors.sparkSession), *key, "i", "j")
    found = cut(met.groupBy(*key, "i", "j").applyInPandas(block, "node long, links long, root long"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = nodes.join(links, "node", "left").join(comp, "node", "left").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    out = rows.where("ok").join(per_node, ["label", "embedding"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
