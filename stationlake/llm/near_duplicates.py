"""Near duplicates by circulant MinHash, banding and exact Jaccard similarity.

Two permutations of the 64-bit numbers make every coordinate of a signature: shingle hashes
go through the first, are shifted by ``k`` on the circle of all numbers and go through the
second; the smallest result is coordinate ``k``.  Coordinates are joined to bands of four.

Groups are never expanded to pairs.  Equal sets become one node.  In a bucket (nodes that
share a band) each node is compared with one leader, the node whose buckets are largest.
Nodes of one bucket that are still in different components then meet only if counts of
their shingles in 256 bins allow the similarity: the sum of the differences of the bins is
at most the number of shingles that only one has, so no link is lost by this.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import list_column, slices, words_of
from stationlake.session import materialise

BANDS, ROWS, BINS = 24, 4, 256

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> _SHIFT)) * _M[2]
    x = (x ^ (x >> _SHIFT)) * _M[2]
    return x ^ (x >> _SHIFT)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole text if it has fewer words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(
        (xxhash.xxh3_64_intdigest(w.lower()) for w in words), np.uint64, len(words)
    )
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * _M[0]
        out ^= out >> _SHIFT
    out = _mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if n > 1 else out


def signatures(shingles: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` coordinates for each of the sets laid one after another."""
    first = _mix(shingles ^ _M[1])
    out = np.empty((count, len(starts)), np.uint64)
    for k in range(count):
        # second permutation of the shifted value
        y = (first - np.uint64(k)) * _M[0]
        y ^= y >> _SHIFT
        y *= _M[2]
        out[k] = np.minimum.reduceat(y, starts)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One number per band and set; the same coordinates in another band give another number."""
    bands = len(signature) // rows
    out = np.empty((bands, signature.shape[1]), np.int64)
    for b in range(bands):
        key = np.full(signature.shape[1], b + 1, np.uint64)
        for c in signature[b * rows : (b + 1) * rows]:
            key = _mix(key ^ c) * _M[0]
        out[b] = key.view(np.int64)
    return out


def _sign(batches, width: int, bands: int, rows: int):
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [shingle_set(x, width) for x in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.nonzero(sizes)[0]
            keys = np.zeros((bands, 0), np.int64)
            bins = np.zeros((len(full), BINS), np.int8)
            if len(full):
                shingles = np.concatenate([sets[i] for i in full])
                starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                keys = band_keys(signatures(shingles, starts, bands * rows), rows)
                for j, i in enumerate(full):
                    counts = np.bincount((sets[i] >> np.uint64(56)).astype(np.int64), minlength=BINS)
                    bins[j] = np.minimum(counts, 127)
            has = (sizes > 0).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(has)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    list_column(keys.T.ravel(), ends * bands, pa.int64()),
                    list_column(bins.ravel(), ends * BINS, pa.int8()),
                ],
                ["doc_id", "n", "digest", "bands", "bins"],
            )


def _sets(batches, width: int):
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [shingle_set(x, width) for x in batch.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            flat = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), list_column(flat, ends, pa.int64())], ["id", "shingles"]
            )


def components(edges: DataFrame) -> DataFrame:
    """``id, label`` of the nodes of ``edges (a, b)``: the smallest id that can be reached.

    Labels go along edges and then to the label's own label, so that long chains shrink by
    half; every round is written to the shared folder.
    """
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(
        both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "id").select(
            "id", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("up"))
        after = materialise(
            hooked.join(up, "label").select("id", "was", F.col("up").alias("label")), "labels"
        )
        labels = after.select("id", "label")
        if not after.where("was <> label").head(1):
            return labels


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sets are similar enough, by the full sets."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(F.lit(100) * both >= F.lit(percent) * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Components of documents whose sets of ``width``-word shingles are similar.

    Two documents are linked if their Jaccard similarity is at least ``percent``/100.  A pair
    of similarity 0.8 is missed by all 24 bands with probability 3e-6, a closer one less.

    Returns per row of ``docs (doc_id, text)``: ``doc_id``, ``n_shingles``, ``component_id``
    (smallest doc_id reachable), ``kept`` (is it that one).  A null or empty text, or one
    without words, has no shingles and stays alone.  A row without doc_id is never linked:
    its component_id is null and it is kept.  Rows with equal doc_id go each by its own text;
    texts whose smallest doc_id is the same count as one.  No rows give no rows.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialise(
        docs.mapInArrow(
            partial(_sign, width=width, bands=bands, rows=rows),
            "doc_id long, n long, digest binary, bands array<long>, bins array<tinyint>",
        ),
        "signed",
    )
    nodes = materialise(
        signed.where("n > 0 and doc_id is not null")
        .groupBy("digest", "n")
        .agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bins").alias("bins")),
        "nodes",
    )
    placed = nodes.select("id", F.explode("bands").alias("bucket"))
    sizes = materialise(
        placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets"
    )
    members = materialise(placed.join(sizes, "bucket"), "members")
    weights = members.groupBy("id").agg(F.sum("size").alias("weight"), F.count("*").alias("in"))
    leaders = materialise(
        members.join(weights, "id")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top"))
        .select("bucket", (-F.col("top.id")).alias("leader")),
        "leaders",
    )
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    sets = materialise(
        docs.join(ids, "doc_id", "left_semi").mapInArrow(
            partial(_sets, width=width), "id long, shingles array<long>"
        ),
        "sets",
    )
    star = (
        members.join(leaders, "bucket")
        .where("id <> leader")
        .select(F.col("leader").alias("a"), F.col("id").alias("b"))
        .distinct()
    )
    first = components(_links(star, sets, percent))

    # buckets that still hold several components
    held = members.join(first, "id", "left").select(
        "bucket", "id", F.coalesce("label", "id").alias("label")
    )
    mixed = materialise(
        held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("bucket"),
        "mixed",
    )
    open_ = materialise(held.join(mixed, "bucket").join(nodes.drop("digest"), "id"), "open")
    left, right = open_.alias("l"), open_.alias("r")
    shared = F.array_position(F.zip_with("l.bands", "r.bands", lambda x, y: x == y), True)
    apart = F.aggregate(
        F.zip_with("l.bins", "r.bins", lambda x, y: F.abs(x.cast("int") - y.cast("int"))),
        F.lit(0),
        lambda x, y: x + y,
    )
    total = F.col("l.n") + F.col("r.n")
    meets = (
        (F.col("l.bucket") == F.col("r.bucket"))
        & (F.col("l.id") < F.col("r.id"))
        & (F.col("l.label") != F.col("r.label"))
        & (F.col("l.n") * 100 >= F.col("r.n") * percent)
        & (F.col("r.n") * 100 >= F.col("l.n") * percent)
        # once for each pair, in the first bucket that it shares
        & (F.element_at("l.bands", shared.cast("int")) == F.col("l.bucket"))
        # similar sets differ by at most (100 - percent) / (100 + percent) of both sizes
        & (apart * (100 + percent) <= total * (100 - percent))
    )
    rest = left.join(right, meets).select(
        F.col("l.id").alias("a"), F.col("r.id").alias("b")
    )
    more = _links(rest, sets, percent)
    label = first.select(F.col("id").alias("a"), F.col("label").alias("la"))
    joined = (
        more.join(label, "a", "left")
        .join(label.toDF("b", "lb"), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    second = components(joined).toDF("label", "component_id")
    # an id that only the second step linked is its own label in the first
    known = first.union(
        second.join(first.select(F.col("id").alias("label")), "label", "left_anti").select(
            F.col("label").alias("id"), "label"
        )
    )
    final = known.join(second, "label", "left").select(
        "id", F.coalesce("component_id", "label").alias("component_id")
    )
    classes = materialise(
        nodes.select("digest", "n", "id")
        .join(final, "id", "left")
        .select("digest", "n", F.coalesce("component_id", "id").alias("of")),
        "classes",
    )
    alone = signed.select("doc_id", "n", "digest")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id"))
    return alone.join(classes, ["digest", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"),
    )
