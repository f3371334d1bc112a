"""A manifest of a dataset as trees of SHA-256 values, whose parents keep the hash states before each child for folding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, over_runs, run_bounds, shuffle_parts

#: Children of a node, and levels that one task builds over a block of WAYS**LEVELS consecutive nodes.
WAYS, LEVELS = 3, 6

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

Side = tuple[str, str]


def field(c: Column) -> Column:
    """A value as it enters a leaf: a dash for null, else its length in UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """The hash of a row's values, 64 lower-case hex digits."""
    return F.sha2(F.concat(*map(field, columns)), 256)


class Parent:
    """A node over up to WAYS children: its hash, and a copy of the hash state before each child."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: list[str]):
        self.children, self.states, state = children, [], hashlib.sha256()
        for c in children:
            self.states.append(state.copy())
            state.update(c.encode())
        self.digest = state.hexdigest()

    def side(self, slot: int) -> Side:
        """The siblings to the left and to the right of a child, as hex text."""
        return "".join(self.children[:slot]), "".join(self.children[slot + 1 :])

    def fold(self, slot: int, other: str) -> str:
        """The hash with another child in a slot: only that child and those to its right are hashed."""
        state = self.states[slot].copy()
        state.update((other + "".join(self.children[slot + 1 :])).encode())
        return state.hexdigest()


def levels(nodes: list[str], size: int, depth: int) -> list[list[Parent]]:
    """The parents over a block of nodes, level by level: up to one node where the group of this size is one block, else depth of them."""
    out: list[list[Parent]] = []
    while len(nodes) > 1 if size <= WAYS**depth else len(out) < depth:
        out.append([Parent(nodes[i : i + WAYS]) for i in range(0, len(nodes), WAYS)])
        nodes = [p.digest for p in out[-1]]
    return out


def _blocks(table: pa.Table) -> list[tuple[int, int]]:
    bounds = run_bounds(table, ["run"]).tolist()
    return list(zip(bounds[:-1], bounds[1:], strict=True)) if table.num_rows else []


def _with_run(nodes: DataFrame, width: int, block: int) -> DataFrame:
    """nodes (first, pos, size, node), each of which stands for width leaves, with the number of the first leaf of its block."""
    return nodes.withColumn("run", F.expr(f"first + pos div {block} * {block * width}L"))


def _climb(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes over blocks of nodes that have a run: one for each block."""

    def up(table: pa.Table) -> list:
        first, pos, size = (table.column(c).to_pylist() for c in ("first", "pos", "size"))
        digests, out = table.column("node").to_pylist(), []
        for a, b in _blocks(table):
            made = levels(digests[a:b], size[a], depth)
            out.append((first[a], pos[a] // WAYS**depth, -(-size[a] // WAYS**depth), made[-1][0].digest if made else digests[a]))
        return [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]

    return over_runs(nodes.select("run", "first", "pos", "size", "node"), ["run"], ["pos"], up, "first long, pos long, size long, node string", _parts(nodes))


def _parts(nodes: DataFrame) -> int:
    return shuffle_parts(nodes.sparkSession)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows in the order of group and order, with first (the number of the group's first row), pos (the row's place in its group) and
    size (of the group), all from 0.

    Rows are sorted by ranges, so a group of any size spreads over tasks; of each range only the counts of its groups are needed
    to number its rows. A last key makes all rows differ, so equal ones spread as well.
    """
    rows = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [group, *order, "_tie"]
    rows = cut(rows.repartitionByRange(_parts(rows), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.expr("shiftright(_at, 33)"))
    counts = rows.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    ranges = counts.groupBy("_part").agg(F.sum("_n").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row for each range
    own = Window.partitionBy(group)
    starts = counts.join(F.broadcast(ranges), "_part").select(
        "_part", group, "_from",
        (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")).alias("_earlier"), F.sum("_n").over(own).alias("size"),
        F.min(F.col("_before") + (F.col("_from") - F.shiftleft(F.col("_part"), 33))).over(own).alias("first"),
    )
    return rows.join(starts, ["_part", group]).withColumn("pos", F.col("_earlier") + F.col("_at") - F.col("_from")).drop("_part", "_at", "_from", "_earlier", "_tie")


def _stages(nodes: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each stage with their runs, lowest first, and the last node of each group (first, stage, node)."""
    stages, tops, width = [], None, 1
    while True:
        nodes = _with_run(nodes, width, WAYS**depth)
        stages.append(nodes)
        above = cut(_climb(nodes, depth))
        done = above.where("size = 1").select("first", F.lit(len(stages) - 1).alias("stage"), "node")
        tops = done if tops is None else tops.unionByName(done)
        nodes, width = above.where("size > 1"), width * WAYS**depth
        if nodes.isEmpty():
            return stages, tops


def _below(table: pa.Table, depth: int, each: Callable[[int, int, list[str], list[list[Parent]]], None]) -> None:
    """Calls each(row, place in the block, path, parents) for the nodes of every block; a block's path comes before its nodes."""
    digests, paths, sizes = (table.column(c).to_pylist() for c in ("node", "path", "size"))
    for a, b in _blocks(table):
        made = levels(digests[a + 1 : b], sizes[min(a + 1, b - 1)], depth)
        for i in range(b - a - 1):
            each(a + 1 + i, i, paths[a], made)


def _sides(made: list[list[Parent]], i: int) -> list[str]:
    """The siblings of a block's i-th node at each level of the block: those to its left, those to its right, and so on."""
    out: list[str] = []
    for parents in made:
        out += parents[i // WAYS].side(i % WAYS)
        i //= WAYS
    return out


def _together(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes and, before those of each block, its path."""
    return nodes.withColumn("path", F.lit(None).cast("array<string>")).unionByName(paths.select(F.col("at").alias("run"), F.lit(-1).cast("long").alias("pos"), "path"), allowMissingColumns=True)


def _down(nodes: DataFrame, width: int, paths: DataFrame, depth: int) -> DataFrame:
    """Paths (at, path) of the nodes, out of those of their blocks; at is the number of a node's first leaf."""

    def run(table: pa.Table) -> list:
        at, out = table.column("at").to_pylist(), ([], [])
        _below(table, depth, lambda row, i, path, made: (out[0].append(at[row]), out[1].append(path[:2] + _sides(made, i) + path[2:])))
        return list(out)

    rows = _together(nodes.withColumn("at", F.expr(f"first + pos * {width}L")), paths)
    return over_runs(rows, ["run"], ["pos"], run, "at long, path array<string>", _parts(nodes))


def _paths(stages: list[DataFrame], tops: DataFrame, given: DataFrame, depth: int) -> DataFrame:
    """Paths (at, path) of the blocks of the lowest stage, out of given (at, path) for each group's last node.

    A path is what lies above a node: the hash of its group, the root, and the siblings at each level, left and right.
    """
    ends = tops.select("stage", F.col("first").alias("at")).join(given, "at")
    paths = None
    for stage in range(len(stages) - 1, -1, -1):
        own = ends.where(F.col("stage") == stage).select("at", "path")
        paths = own if paths is None else own.unionByName(paths)
        if stage:
            paths = cut(_down(stages[stage], WAYS ** (depth * stage), paths, depth))
    return paths


def manifest(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", text: str = "text", depth: int = LEVELS) -> DataFrame:
    """The manifest of docs: for each row `order`, leaf, subroot, root, siblings (array: hashes to the left and to the right of its
    node, level by level up to the root), proof_sha256 (their hash), folded_root and verified.

    The rows of a group in order, and then the groups in order, are gathered three by three until one node is left. folded_root is
    what the root becomes if the row's text is `changed` (null: it stays), by resuming the states that the parents on its way have
    kept; verified says whether that is the root.

    Leaves are hashed once and without a shuffle, and texts go no further. Rows are numbered by ranges, so a group of any size is
    spread; a task holds blocks of 3**depth (729) nodes, each of which gives one node of the next stage, and a block's way to the root
    is found once and given to its rows. The number of stages grows with the logarithm to base 729.

    A null order comes first, a null group too, and is `-` in the leaf; a row of null order keeps its text. Rows of equal order
    follow each other by leaf; equal rows are leaves of their own. Of an empty table nothing comes. Other columns are not read.
    """
    values = [F.col(c) for c in columns]
    new = F.coalesce(changed, F.col(text)) if changed is not None else F.col(text)
    other = leaf([new.alias(text) if c == text else F.col(c) for c in columns])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("_group"), F.col(order).alias("_key"), leaf(values).alias("node"),
        (F.when(new != F.col(text), other) if changed is not None else F.lit(None).cast("string")).alias("other"),
    )
    rows = cut(numbered(leaves, "_group", ["_key", "node"]).drop("_group"))
    stages, tops = _stages(rows, depth)
    tops = cut(tops)
    # The groups' last nodes are the leaves of one more tree, in the order of the groups.
    over = cut(numbered(tops.select(F.lit("").alias("_group"), F.col("first").alias("_own"), "node"), "_group", ["_own"]).drop("_group"))
    upper_stages, root = _stages(over, depth)
    upper = _paths(upper_stages, root, root.select(F.col("first").alias("at"), F.array(F.lit(""), "node").alias("path")), depth)
    given = over.select((F.col("first") + F.col("pos")).alias("at"), "_own", "node").join(_down(upper_stages[0], 1, upper, depth), "at").select(
        F.col("_own").alias("at"), F.concat(F.array("node"), F.expr("slice(path, 2, size(path))")).alias("path")
    )
    return _folded(stages[0], _paths(stages, tops, cut(given), depth), docs.schema[order].dataType.simpleString(), order, depth)


def _folded(nodes: DataFrame, paths: DataFrame, kind: str, order: str, depth: int) -> DataFrame:
    """The results for leaves: their own sides within the block, and their block's way from there to the root."""

    def run(table: pa.Table) -> list:
        keys, digests, others = (table.column(c).to_pylist() for c in ("_key", "node", "other"))
        out: list[tuple] = []
        last: list = [None, []]  # the states on a block's way to the root, before its node

        def each(row: int, i: int, path: list[str], made: list[list[Parent]]) -> None:
            if last[0] is not path:
                last[:] = [path, [(hashlib.sha256(left.encode()), right) for left, right in zip(path[2::2], path[3::2], strict=True)]]
            own = _sides(made, i)
            siblings = own + path[2:]
            value, at = others[row] or digests[row], i
            for parents in made:
                value = parents[at // WAYS].fold(at % WAYS, value)
                at //= WAYS
            for kept, right in last[1]:
                state = kept.copy()
                state.update((value + right).encode())
                value = state.hexdigest()
            single = [s[n : n + 64] for s in siblings for n in range(0, len(s), 64)]
            out.append((keys[row], digests[row], path[0], path[1], single, hashlib.sha256("".join(siblings).encode()).hexdigest(), value, value == path[1]))

        _below(table, depth, each)
        return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(8)]

    ddl = f"`{order}` {kind}, leaf string, subroot string, root string, siblings array<string>, proof_sha256 string, folded_root string, verified boolean"
    return over_runs(_together(nodes, paths), ["run"], ["pos"], run, ddl, _parts(nodes))
