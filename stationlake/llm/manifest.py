"""Merkle manifest of a dataset: a hash tree per source, one over the sources, and folded proofs.

Every parent hashes the hex digests of up to three children and retains a copy of its hash state
before each child.  To fold a changed leaf, the copy before its slot takes the new digest
and the siblings to the right; what lies to the left is never hashed again.

Trees grow in blocks of 3^6 nodes, so a round of blocks settles six levels and no task holds more of
a source, however many rows that has.  On the way down each block gets from the round above the
siblings on the way from its top to the root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.operators.ordered import POS, SIZE, attach_stored, lay_out
from stationlake.session import materialise

FAN = 3

#: Levels that a round of blocks settles.
DEPTH = 6

_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Tree:
    """Digests level by level; ``states`` has, for each child, its parent's hash state before it."""

    levels: list[list[str]]
    states: list[list]

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, level: int, at: int) -> tuple[str, str]:
        """The digests of the run of three, left and right of a node."""
        run, first = self.levels[level], at - at % FAN
        return "".join(run[first:at]), "".join(run[at + 1 : first + FAN])

    def path(self, at: int) -> list[tuple[str, str]]:
        return [self.siblings(level, at // FAN**level) for level in range(len(self.states))]


def grow(nodes: list[str], depth: int | None) -> Tree:
    """The tree over a block: ``depth`` levels, or up to its only node if it is a whole tree."""
    levels, states = [nodes], []
    while len(levels[-1]) > 1 if depth is None else len(levels) <= depth:
        below, copies, parents = levels[-1], [], []
        for first in range(0, len(below), FAN):
            state = hashlib.sha256()
            for child in below[first : first + FAN]:
                copies.append(state.copy())
                state.update(child.encode())
            parents.append(state.hexdigest())
        states.append(copies)
        levels.append(parents)
    return Tree(levels, states)


def resume(state, child: str, right: str) -> str:
    """A parent's digest from its state before the child; the state itself stays as it is."""
    state = state.copy()
    state.update(child.encode())
    state.update(right.encode())
    return state.hexdigest()


def _value(c: Column) -> Column:
    text = c.cast("string")
    size = F.octet_length(text).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))


def leaves(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, ``source``, ``leaf`` and, where the row is tampered with, ``changed``."""
    key = F.col("doc_id").cast("string")

    def leaf(text: Column) -> Column:
        others = [_value(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
        return F.sha2(F.concat(*others, _value(text)), 256)

    text = F.col("text").cast("string")
    shorter = leaf(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        leaf(text).alias("leaf"),
        F.when(F.crc32(key.cast("binary")) % 2 == 0, shorter).alias("changed"),
    )


def _blocks(nodes: DataFrame, keys: list[str], depth: int, item: list[str]) -> DataFrame:
    """One row per block with its nodes in order, ``FAN**depth`` at most.

    ``depth`` stays null in a block that is a whole tree.
    """
    most = FAN**depth
    members = F.struct(F.col(POS).alias("pos"), "digest", F.struct(*item).alias("item"))
    return nodes.groupBy(*keys, F.expr(f"{POS} div {most}L").alias("block")).agg(
        F.max(SIZE).alias("size"),
        F.max(F.when(F.col(SIZE) > most, depth)).alias("depth"),
        F.sort_array(F.collect_list(members)).alias("nodes"),
    )


def _trees(batches):
    """Each block alone: its row as a batch, its nodes as an array, and its tree."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            nodes = row.column("nodes").flatten()
            yield row, nodes, grow(nodes.field("digest").to_pylist(), row.column("depth")[0].as_py())


def _tops(batches):
    for row, _, tree in _trees(batches):
        names = [c for c in row.schema.names if c != "nodes"]
        yield pa.RecordBatch.from_arrays(
            [*[row.column(c) for c in names], pa.array([tree.top])], [*names, "digest"]
        )


def _above(row, tree: Tree) -> tuple[list[tuple[str, str]], list[str]]:
    """The siblings beyond the block, and the tops of the trees from here on."""
    path = [(s["left"], s["right"]) for s in row.column("path")[0].as_py()]
    own = [tree.top] if row.column("depth")[0].as_py() is None else []
    return path, own + row.column("ends")[0].as_py()


def _descend(batches):
    """Per node the siblings from it to the root, and the subroot and root at the end."""
    for row, nodes, tree in _trees(batches):
        path, ends = _above(row, tree)
        n = len(nodes)
        steps = pa.array(
            [[{"left": a, "right": b} for a, b in tree.path(i) + path] for i in range(n)],
            pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])),
        )
        keys = [c for c in row.schema.names if c not in ("block", "size", "depth", "nodes", "path", "ends")]
        yield pa.RecordBatch.from_arrays(
            [
                *[row.column(c).take(pa.array([0] * n)) for c in keys],
                nodes.field("pos"),
                nodes.field("item"),
                steps,
                pa.array([ends] * n, pa.list_(pa.string())),
            ],
            [*keys, "pos", "item", "path", "ends"],
        )


def _fold(batches):
    for row, nodes, tree in _trees(batches):
        path, (subroot, root) = _above(row, tree)
        # outside the block all leaves share the parents: their states before the way up
        outer = [(hashlib.sha256(left.encode()), right) for left, right in path]
        rest = "".join(left + right for left, right in path)
        item = nodes.field("item")
        proofs, folded = [], []
        for i, changed in enumerate(item.field("changed").to_pylist()):
            own = tree.path(i)
            proofs.append(digest("".join(left + right for left, right in own) + rest))
            node = changed or tree.levels[0][i]
            for level, (_, right) in enumerate(own):
                node = resume(tree.states[level][i // FAN**level], node, right)
            for state, right in outer:
                node = resume(state, node, right)
            folded.append(node)
        n = len(nodes)
        yield pa.RecordBatch.from_arrays(
            [
                item.field("doc_id"),
                nodes.field("digest"),
                pa.array([subroot] * n),
                pa.array([root] * n),
                pa.array(proofs),
                pa.array(folded),
                pa.array([f == root for f in folded]),
            ],
            ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def _ddl(df: DataFrame, names: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{c}` {types[c]}, " for c in names)


def _climb(nodes: DataFrame, keys: list[str], depth: int, item: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, lowest first, and the top of every tree."""
    rounds, finished = [], []
    most = nodes.agg(F.max(SIZE)).first()[0] or 0
    while not rounds or most > 1:
        blocks = materialise(_blocks(nodes, keys, depth, [POS] if rounds else item), "blocks")
        ddl = _ddl(blocks, [*keys, "block", "size", "depth"]) + "digest string"
        tops = materialise(blocks.mapInArrow(_tops, ddl), "tops")
        rounds.append(blocks)
        finished.append(tops.where(F.col("depth").isNull()).select(*keys, "digest"))
        most = -(-most // FAN**depth)
        nodes = tops.where(F.col("depth").isNotNull()).select(
            *keys,
            F.col("block").alias(POS),
            F.expr(f"(size + {FAN**depth - 1}L) div {FAN**depth}L").alias(SIZE),
            "digest",
        )
    return rounds, reduce(DataFrame.unionByName, finished)


def _ways(blocks: DataFrame, keys: list[str]) -> DataFrame:
    item = blocks.schema["nodes"].dataType.elementType["item"].dataType.simpleString()
    ddl = _ddl(blocks, keys) + f"pos long, item {item}, path {_PATH}, ends array<string>"
    return blocks.mapInArrow(_descend, ddl)


def _with_ways(rounds: list[DataFrame], keys: list[str], outside: DataFrame) -> DataFrame:
    """The lowest blocks, each with the way from its top to the root.

    ``outside`` has, per key, the way on from the top of its tree.
    """
    joined = None
    for blocks in reversed(rounds):
        tops = blocks.where(F.col("depth").isNull())
        ends = attach_stored(tops, outside, keys)
        if joined is not None:  # blocks of larger trees get theirs from the round above
            ways = _ways(joined, keys).select(*keys, F.col("pos").alias("block"), "path", "ends")
            parts = blocks.where(F.col("depth").isNotNull())
            ends = ends.unionByName(attach_stored(parts, ways, [*keys, "block"]))
        joined = ends
    return joined


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id`` and the proof of every row of ``docs`` in the hash tree of the dataset.

    ``leaf`` hashes the row's five columns, ``subroot`` is the top of its source's tree, ``root`` that
    over all sources, ``proof_sha256`` hashes the siblings from leaf to root, ``folded_root`` is the
    root that follows from the row as found (line feeds deleted from texts of tampered rows) and
    the siblings, ``verified`` whether it is the root.  Leaves of a source stand by ``doc_id``, null first,
    equal ones by their digests.  Nulls in any column hash as a dash; a null source is a source of
    its own, a row without ``doc_id`` is not tampered with.  Repeated rows are leaves of their own.  No rows
    give no rows.  Other columns are ignored.
    """
    found = leaves(docs).withColumnRenamed("leaf", "digest")
    laid = lay_out(found, ["source"], ["doc_id", "digest"])
    rounds, subroots = _climb(laid, ["source"], depth, ["doc_id", "changed"])
    sources = lay_out(materialise(subroots, "subroots"), [], ["source"])
    top_rounds, _ = _climb(sources, [], depth, ["source"])
    nowhere = docs.sparkSession.range(1).select(
        F.array().cast(_PATH).alias("path"), F.array().cast("array<string>").alias("ends")
    )
    outside = _ways(_with_ways(top_rounds, [], nowhere), []).select("item.source", "path", "ends")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _with_ways(rounds, ["source"], materialise(outside, "ways")).mapInArrow(
        _fold,
        f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )
