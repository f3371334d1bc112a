"""Near-duplicate documents by Jaccard similarity of word n-grams, found with a MinHash LSH forest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Forest, add_columns, components, cut, over_runs, prefix_values, run_bounds, shuffle_parts, window_values, words

WORDS, THRESHOLD = 5, 0.8
#: Trees of the forest, hash values on a full path, and the recall that ends the shortening of matched prefixes.
TREES, PATH, RECALL = 24, 6, 0.99999
#: Documents and shingles compared at once; larger buckets and groups are cut into blocks of this size.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_RNG = np.random.default_rng(77)
_A = (_RNG.integers(0, 2**31, TREES * PATH, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, TREES * PATH, dtype=np.uint32)[:, None]


def recall_at(depth: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """Chance that two documents of this similarity share a path prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(recall: float = RECALL, similarity: float = THRESHOLD) -> int:
    """The longest prefix that reaches this recall even if every similar pair is only just at the threshold (1 at the least)."""
    return next((d for d in range(PATH, 1, -1) if recall_at(d, similarity) >= recall), 1)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit values of a text's word n-grams; a text of 1 to n-1 words is one shingle; none without words."""
    tokens = words((text or "").encode())
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(b" ".join(tokens), dtype=np.uint8)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    end = np.cumsum(lengths + 1) - 1
    start, width = end - lengths, min(n, len(tokens))
    return np.unique(window_values(prefix_values(data), start[: len(start) - width + 1], end[width - 1 :]))


def signature(values: np.ndarray) -> np.ndarray:
    """TREES x PATH least values under as many 32-bit permutations."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * PATH, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        h = (x[i : i + 2048] ^ _B) * _A
        np.minimum(out, (h ^ (h >> np.uint32(15))).min(axis=1), out=out)
    return out.reshape(TREES, PATH)


def _sign(texts: list) -> list[list]:
    """For each text: a digest of its set of shingles, its paths (16 bits a value, one tree after another) and how many there are."""
    kinds, sigs, sizes = [], [], []
    for text in texts:
        s = shingles(text)
        sizes.append(len(s))
        kinds.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        sigs.append(signature(s).astype(">u2").tobytes() if len(s) else None)
    return [kinds, sigs, sizes]


#: Estimates from TREES * PATH values are off by less than MARGIN, six standard deviations, for pairs at the threshold.
MARGIN = 6 * (THRESHOLD * (1 - THRESHOLD) / (TREES * PATH)) ** 0.5
#: Estimates from which a pair is a candidate, and from which a document may be similar to one that is near a leader.
NEAR = THRESHOLD - MARGIN
REACH = max(0.0, NEAR + THRESHOLD - 1 - MARGIN)
#: Buckets of up to this many documents are compared pair by pair, larger ones through leaders; both find every candidate.
FEW = 32

_LINKED = "key long, part long, a long, b long, alike float, lead boolean, sig binary"


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint16).reshape(table.num_rows, -1)


def _link_buckets(table: pa.Table) -> list:
    """Links each document of a trie node to the candidates in it: one edge a document, from it to the root of its chain.

    In a large node, documents are taken in the order of their paths, as in the sorted trie. A document opens a leader unless an
    earlier leader is so near that whatever is similar to the document is near the leader too; it is chained to every leader within
    that wider reach. Two documents at the threshold thus always meet in one chain, with as many comparisons as documents times
    leaders. Rows of leaders keep their signatures, for the other parts of a node that is dealt out in parts.
    """
    sig, node = _signatures(table), table.column("node").to_numpy()
    bounds = run_bounds(table, ["key", "part"])
    size = np.diff(bounds)
    root = np.arange(len(node))
    lead = np.zeros(len(node), dtype=bool)
    split = table.column("split").to_numpy(zero_copy_only=False)
    two = bounds[:-1][size == 2]
    close = (sig[two] == sig[two + 1]).mean(axis=1) >= NEAR
    root[two[close] + 1] = two[close]
    for i, n in zip(bounds[:-1].tolist(), size.tolist(), strict=True):
        if split[i]:
            lead[i : i + n], forest = _lead(sig[i : i + n])
        elif n <= 2:
            continue
        elif n <= FEW:
            a, b = np.nonzero(np.triu((sig[i : i + n, None] == sig[None, i : i + n]).mean(axis=2) >= NEAR, 1))
            forest = Forest(n)
            forest.join_all(a, b)
        else:
            _, forest = _lead(sig[i : i + n])
        root[i : i + n] = forest.up + i
    keep = np.flatnonzero((root != np.arange(len(node))) | lead)
    kept = [x if led else None for x, led in zip(table.column("sig").take(pa.array(keep)).to_pylist(), lead[keep].tolist(), strict=True)]
    return [
        table.column("key").to_numpy()[keep], table.column("part").to_numpy()[keep], node[keep], node[root[keep]],
        (sig[keep] == sig[root[keep]]).mean(axis=1).astype(np.float32), lead[keep], kept,
    ]


def _lead(sig: np.ndarray) -> tuple[np.ndarray, Forest]:
    forest, lead, todo = Forest(len(sig)), np.zeros(len(sig), dtype=bool), np.arange(len(sig))
    while len(todo):
        alike = (sig == sig[todo[0]]).mean(axis=1)
        within = np.flatnonzero(alike >= REACH)
        forest.join_all(np.full(len(within), todo[0]), within)
        lead[todo[0]] = True
        todo = todo[1:][alike[todo[1:]] < NEAR]
    return lead, forest


def _link_to_leaders(table: pa.Table) -> list:
    """Chains the members of one part of a large node to the leaders of its other parts, within the same reach."""
    sig, node, lead = _signatures(table), table.column("node").to_numpy(), table.column("lead").to_numpy(zero_copy_only=False)
    bounds = run_bounds(table, ["key", "part"])
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        forest = Forest(j - i)
        for x in np.flatnonzero(lead[i:j]):
            within = np.flatnonzero((sig[i:j] == sig[i + x]).mean(axis=1) >= REACH)
            forest.join_all(np.full(len(within), x), within)
        a.append(node[i:j]), b.append(node[i + forest.up])
    a, b = np.concatenate(a), np.concatenate(b)
    return [a[a != b], b[a != b]]


def _common(sets: list[np.ndarray], left: int) -> np.ndarray:
    """How many shingles each of the first `left` sets shares with each of all sets."""
    n = len(sets)
    if n == 2:
        both = np.searchsorted(sets[1], sets[0])
        both[both == len(sets[1])] = 0
        shared = np.count_nonzero(sets[1][both] == sets[0])
        return np.array([[len(sets[0]), shared], [shared, len(sets[1])]], dtype=np.float32)[:left]
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.concatenate([[True], every[1:] != every[:-1]])
    held = np.diff(np.append(np.flatnonzero(first), len(every)))
    column = np.cumsum(first) - 1
    shared = held[column] > 1
    owner, column = owner[shared], (np.cumsum(held > 1) - 1)[column[shared]]
    common, width = np.zeros((left, n), dtype=np.float32), max(1, 4_000_000 // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - low)), dtype=np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        common += part[:left] @ part.T
    return common


def _verify(table: pa.Table) -> list:
    """Exact Jaccard similarity of the documents of block i with those of block j of one group (i = j: with each other)."""
    bounds = run_bounds(table, ["grp", "i", "j"])
    node, weight, side = (table.column(c).to_numpy() for c in ("node", "n", "side"))
    texts = table.column("text").to_pylist()
    links, root = np.zeros(len(node), dtype=np.int64), node.copy()
    for f, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n, m = e - f, int(np.count_nonzero(side[f:e] == 0))
        own = m == n
        if m == 0 or n < 2:
            continue
        sets = [shingles(t) for t in texts[f:e]]
        size = np.array([len(s) for s in sets], dtype=np.float64)
        common = _common(sets, m)
        linked = common >= THRESHOLD * (size[:m, None] + size[None, :] - common) - 1e-9
        linked &= common > 0
        if own:
            np.fill_diagonal(linked, False)
            links[f:e] = linked @ weight[f:e]
        else:
            linked = linked[:, m:]
            links[f : f + m], links[f + m : e] = linked @ weight[f + m : e], linked.T @ weight[f : f + m]
        forest, (a, b) = Forest(n), np.nonzero(linked)
        forest.join_all(a, b + (0 if own else m))
        root[f:e] = node[f:e][forest.up]
    return [node, links, root]


def _candidates(nodes: DataFrame, depth: int, parts: int, block: int) -> tuple[DataFrame, float]:
    """Edges (a, b) that chain the candidates at one depth of the trie, and the estimated recall of what lies over the threshold.

    Each edge carries the estimated similarity s of its ends. Pairs of similarity s share a prefix of this depth in some tree with
    the chance P(s); so those found stand for the sum of 1 / P(s), and the recall is their number over that sum.
    """
    paths = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "node", F.xxhash64("tree", F.expr(f"substring(sig, tree * {2 * PATH} + 1, {2 * depth})")).alias("key"),
        F.expr(f"substring(sig, tree * {2 * PATH} + {2 * depth + 1}, {2 * (PATH - depth)})").alias("rest"),
    )
    busy = paths.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = paths.join(busy, "key").withColumn("split", F.col("m") > 4 * block).withColumn(
        "part", F.when(F.col("split"), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / (2 * block)).cast("long"))).otherwise(0)
    ).join(nodes.select("node", "sig"), "node")
    met = cut(met.select("key", "part", "split", "rest", "node", "sig"))
    parts = max(parts, met.count() // 20_000)
    first = cut(over_runs(met, ["key", "part"], ["rest", "node"], _link_buckets, _LINKED, parts))
    heads = first.where("lead").join(met.where("split").select("key", F.col("part").alias("other")).distinct(), "key").where("part <> other")
    second = over_runs(
        met.where("split").select("key", "part", "node", "sig", F.lit(False).alias("lead"))
        .union(heads.select("key", "other", "a", "sig", F.lit(True))), ["key", "part"], ["lead", "node"], _link_to_leaders, "a long, b long", parts,
    )
    found = first.where(F.col("alike") >= THRESHOLD).groupBy("a", "b").agg(F.first("alike").alias("s"))
    chance = 1 - F.pow(1 - F.pow(F.col("s").cast("double"), F.lit(float(depth))), F.lit(float(TREES)))
    seen = found.agg(F.count("*").alias("n"), F.sum(1 / chance).alias("total")).first()
    return first.select("a", "b").union(second), (seen["n"] / seen["total"] if seen["n"] else recall_at(depth))


def near_duplicates(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Classes of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    docs needs doc_id (long) and text (string); other columns are ignored. Returns one row per input row: doc_id, n_links
    (documents linked directly), component_id (least doc_id reachable by links) and kept (doc_id = component_id). Words are runs
    of letters and digits, A-Z lower-cased; a text of fewer than five words is one shingle; a null text, one without words, or a
    null doc_id links with nothing and is kept (component_id is then doc_id). Rows that share a doc_id count as copies of one
    document if their texts do, else their links are joined under that id.

    Documents with equal shingle sets become one node with a weight. Each node puts its path into every tree of the forest, and
    each tree is sorted. Matching begins at whole paths; while the recall estimated from what has been matched is below the
    target, prefixes are shortened by one value and matched again. What shares a prefix and has like signatures is chained into
    candidate groups, and every pair inside a group is checked exactly, block against block, which counts links without emitting
    them. Blocks are bounded by documents and by shingles, so very long texts do not meet in one task.
    """
    signed = cut(add_columns(docs.select("doc_id", "text"), ["text"], _sign, "class binary, sig binary, size long", drop=("text",)))
    held = signed.where("class is not null and doc_id is not null")
    nodes = cut(held.groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size")))
    parts = shuffle_parts(docs.sparkSession)
    for depth in range(PATH, 0, -1):
        edges, estimate = _candidates(nodes, depth, parts, BLOCK)
        if estimate >= recall or depth <= depth_for(recall):
            break
    group = components(edges).withColumnRenamed("component", "grp")
    # A doc_id that stands for several texts is one node with all of them.
    weight = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    joined = cut(group.join(weight, "node"))
    sizes = joined.groupBy("grp").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("parts")
    )
    members = joined.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")))
    texts = docs.select("doc_id", "text").where("doc_id is not null").join(
        members.withColumnRenamed("node", "doc_id").hint("shuffle_hash"), "doc_id"
    ).select(F.col("doc_id").alias("node"), "text", "grp", "parts", "block", "n").dropDuplicates(["node", "text"])
    # Block i meets each block j: row blocks are replicated once for every other block, pairs are never emitted.
    grid = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    grid = grid.select(
        "node", "text", "grp", "n", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    whole = joined.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    checked = cut(over_runs(
        grid, ["grp", "i", "j"], ["side", "node"], _verify, "node long, links long, root long", max(parts, int(whole // (2 * BLOCK_SHINGLES))), 512
    ))
    comp = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    by_class = (
        nodes.select("class", "node", "n").join(links, "node", "left").join(comp, "node", "left")
        .select("class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    single = signed.where("class is null or doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"))
    out = held.select("doc_id", "class").join(by_class, "class").select("doc_id", "n_links", "component_id").unionByName(single)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
