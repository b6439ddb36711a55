"""Nearest neighbours by a forest of random-projection trees.

The forest is fitted on a bounded sample and every row is placed in one leaf of each tree.  A
query walks all trees through one priority queue, nearest boundary first, until the leaves
it has opened hold a given share of the sample.  Queries and rows of a leaf meet in blocks
of bounded size; distances of the candidates are exact, in double precision.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.session import materialise


@dataclass(frozen=True)
class Search:
    """``fit_rows``: rows of the sample, in expectation.  ``share``: part of the sample whose leaves
    a query opens; recall rises with it.  ``block``: rows, and queries, that meet at once."""

    neighbours: int = 10
    trees: int = 4
    leaf: int = 256
    fit_rows: int = 20_000
    share: float = 0.75
    block: int = 4096
    seed: int = 7


@dataclass
class Tree:
    """Inner nodes in order; a child at least 0 is a node, else leaf ``-1 - child``."""

    planes: list[np.ndarray] = field(default_factory=list)
    cuts: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def grow(self, points: np.ndarray, ids: np.ndarray, most: int, rng) -> int:
        """Split at the median of the projection on the line through two random points."""
        pair = points[ids[rng.choice(len(ids), 2, replace=False)]] if len(ids) > most else None
        if pair is None or not np.any(pair[0] != pair[1]):
            return self._leaf(ids)
        plane = (pair[0] - pair[1]) / np.linalg.norm(pair[0] - pair[1])
        at = points[ids] @ plane
        middle = np.sort(at)[len(at) // 2 - 1 : len(at) // 2 + 1]
        cut = float(middle.mean())  # between two points, so that rounding moves none
        right = at >= cut
        if right.all() or not right.any():
            return self._leaf(ids)
        node = len(self.planes)
        self.planes.append(plane)
        self.cuts.append(cut)
        self.children.append((0, 0))
        low = self.grow(points, ids[~right], most, rng)
        self.children[node] = (low, self.grow(points, ids[right], most, rng))
        return node

    def _leaf(self, ids: np.ndarray) -> int:
        self.leaves.append(ids)
        return -len(self.leaves)

    def place(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        at = np.zeros(len(points), np.int64) if self.planes else np.full(len(points), -1)
        planes = np.array(self.planes)
        while True:
            inner = np.nonzero(at >= 0)[0]
            if not len(inner):
                return -1 - at
            node = at[inner]
            side = np.einsum("ij,ij->i", points[inner], planes[node]) >= np.array(self.cuts)[node]
            at[inner] = np.array(self.children)[node, side.astype(int)]


@dataclass
class Forest:
    size: int  # components of a vector
    sample: int
    trees: list[Tree]

    def visit(self, point: np.ndarray, share: float) -> list[tuple[int, int]]:
        """Trees and leaves that a query opens, by one queue over all trees."""
        seen = np.zeros(self.sample, bool)
        found: list[tuple[int, int]] = []
        queue = [(0.0, t, 0 if tree.planes else -1) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        count = 0
        while queue and (count < share * self.sample or len(found) < len(self.trees)):
            far, t, at = heapq.heappop(queue)
            tree = self.trees[t]
            while at >= 0:
                margin = float(tree.planes[at] @ point) - tree.cuts[at]
                low, high = tree.children[at]
                near, other = (high, low) if margin >= 0 else (low, high)
                heapq.heappush(queue, (max(far, abs(margin)), t, other))
                at = near
            found.append((t, -1 - at))
            seen[tree.leaves[-1 - at]] = True
            count = int(seen.sum())
        return found


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null, NaN or infinite components."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def fit(classes: DataFrame, rows: int, search: Search) -> Forest | None:
    """A forest for the commonest vector length (of equal counts the shorter)."""
    common = (
        classes.groupBy(F.size("vector").alias("size"))
        .count()
        .orderBy(F.col("count").desc(), "size")
        .first()
    )
    if common is None:
        return None
    size = common["size"]
    part = F.shiftrightunsigned(F.xxhash64("key"), 11) / float(1 << 53)
    sample = (
        classes.where((F.size("vector") == size) & (part < search.fit_rows / rows))
        .select("key", "vector")
        .toPandas()
        .sort_values("key")
    )
    if not len(sample):
        sample = classes.where(F.size("vector") == size).select("key", "vector").orderBy("key").limit(1).toPandas()
    points = np.array(sample["vector"].tolist(), np.float64)
    rng = np.random.default_rng(search.seed)
    trees = []
    for _ in range(search.trees):
        trees.append(Tree())
        trees[-1].grow(points, np.arange(len(points)), search.leaf, rng)
    return Forest(size, len(points), trees)


def _points(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _place(batches, forest: Forest):
    for batch in batches:
        if not batch.num_rows:
            continue
        points = _points(batch, "vector")
        for t, tree in enumerate(forest.trees):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(points), t, np.int32)),
                    pa.array(tree.place(points), pa.int32()),
                    batch.column("key"),
                    batch.column("ids"),
                    batch.column("vector"),
                ],
                ["tree", "leaf", "key", "ids", "vector"],
            )


def _open(batches, forest: Forest, share: float):
    for batch in batches:
        for i, point in enumerate(_points(batch, "vector") if batch.num_rows else ()):
            trees, leaves = zip(*forest.visit(point, share))
            one = batch.take(pa.array([i] * len(trees)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.int32()), pa.array(leaves, pa.int32()), *one.columns],
                ["tree", "leaf", *batch.schema.names],
            )


def _meet(queries: pd.DataFrame, rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` nearest classes of a block for each of its queries."""
    out = []
    if len(queries) and len(rows):
        q = np.array(queries["vector"].tolist(), np.float64)
        r = np.array(rows["vector"].tolist(), np.float64)
        first = rows["ids"].map(lambda x: x[0]).to_numpy(np.int64)
        near = (q**2).sum(1)[:, None] + (r**2).sum(1)[None] - 2 * q @ r.T
        for i in range(len(q)):
            at = np.arange(len(r))
            if len(r) > most:
                # rounding of the quick form can't lose a class: all near the limit stay
                limit = np.partition(near[i], most - 1)[most - 1]
                slack = 1e-9 * (1 + abs(limit) + float((q[i] ** 2).sum()))
                at = np.nonzero(near[i] <= limit + slack)[0]
            exact = np.sqrt(((r[at] - q[i]) ** 2).sum(1))
            pick = np.lexsort((first[at], exact))[:most]
            out.append(
                pd.DataFrame(
                    {
                        "query_id": queries["query_id"].iat[i],
                        "query_key": queries["query_key"].iat[i],
                        "key": rows["key"].to_numpy()[at[pick]],
                        "ids": rows["ids"].to_numpy()[at[pick]],
                        "score": exact[pick],
                    }
                )
            )
    columns = ["query_id", "query_key", "key", "ids", "score"]
    return pd.concat(out) if out else pd.DataFrame(columns=columns)


def nearest(
    rows: DataFrame, is_query: Column, search: Search | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: nearest rows found for the rows where ``is_query``.

    ``rows (vec_id, embedding)``: each row may be found but the query itself.  ``score`` is the Euclidean distance
    in double precision; ties go to the smaller vec_id.  Vectors that are null, empty or zero, or
    hold null or non-finite components, take no part, nor do those without vec_id or of another
    length than most.  Equal vectors are one class, of which the smallest ids are enough; a row that is
    repeated counts once.  A vec_id with several vectors is as many queries.
    No rows, or no queries, give no rows; other columns are ignored.
    """
    search = search or Search()
    spark = rows.sparkSession
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    good = rows.select(F.col("vec_id").cast("long"), vector.alias("vector"), is_query.alias("q"))
    good = good.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    kept = search.neighbours + 1
    lowest = Window.partitionBy("vector").orderBy("vec_id")
    # a class needs no more ids than a query can return, and the query's own
    classes = materialise(
        good.withColumn("n", F.dense_rank().over(lowest))
        .where(F.col("n") <= kept)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
        .withColumn("key", F.xxhash64("vector", F.element_at("ids", 1))),
        "classes",
    )
    count = classes.count()
    forest = fit(classes, max(1, count), search) if count else None
    result = "query_id long, rank int, vec_id long, score double"
    if forest is None:
        return spark.createDataFrame([], result)
    asked = materialise(
        good.where(F.col("q") & (F.size("vector") == forest.size))
        .select(F.col("vec_id").alias("query_id"), "vector")
        .distinct()
        .withColumn("query_key", F.xxhash64("vector")),
        "queries",
    )
    queries = asked.count()
    leaves = min(len(t.leaves) for t in forest.trees)
    row_parts = -(-count // (leaves * search.block))
    query_parts = max(1, -(-queries // search.block))
    opened = asked.mapInArrow(
        partial(_open, forest=forest, share=search.share),
        "tree int, leaf int, query_id long, vector array<double>, query_key long",
    ).withColumns(
        {
            "qp": F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"),
            "rp": F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))),
        }
    )
    placed = (
        classes.where(F.size("vector") == forest.size)
        .select("key", "ids", "vector")
        .mapInArrow(
            partial(_place, forest=forest),
            "tree int, leaf int, key long, ids array<long>, vector array<double>",
        )
        .withColumns(
            {
                "rp": F.pmod(F.xxhash64("key"), F.lit(row_parts)).cast("int"),
                "qp": F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))),
            }
        )
    )
    block = ["tree", "leaf", "rp", "qp"]
    found = (
        opened.groupBy(*block)
        .cogroup(placed.groupBy(*block))
        .applyInPandas(
            partial(_meet, most=kept),
            "query_id long, query_key long, key long, ids array<long>, score double",
        )
    )
    each = found.select("query_id", "query_key", F.explode("ids").alias("vec_id"), "score")
    # a candidate met in several trees has the same score in all
    best = (
        each.where("vec_id <> query_id")
        .groupBy("query_id", "query_key", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= search.neighbours)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
