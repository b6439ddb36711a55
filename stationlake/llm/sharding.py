"""Sharding by a hierarchy of weighted hash draws, law ``key``.

Each shard of the tree draws an exponential waiting time of its weight from a hash of the
doc_id and its own name.  The draw of a rack is the earliest of its shards, that of a
region the earliest of its racks: the least of exponential times is again one with the
summed weight, so every level is a weighted draw.  A row descends to the region, rack and
shard with the earliest draw.  A changed weight changes draws in one subtree only, and a
new shard can only take rows to itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import hash_spot, running, unit_hash
from stationlake.session import materialise

SHARDS, SHARDS_PER_RACK, RACKS_PER_REGION = 16, 4, 2


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards in racks of four and regions of two racks; a shard's place never changes."""
    return [
        Leaf(
            s // (SHARDS_PER_RACK * RACKS_PER_REGION),
            s // SHARDS_PER_RACK,
            s,
            (weights or {}).get(s, 1.0),
        )
        for s in range(shards)
    ]


def _draw(key: Column, leaf: Leaf) -> Column:
    """Waiting time of a shard for a key."""
    h = F.xxhash64(key, F.lit(f"shard-{leaf.shard}"))
    # 53 bits, in (0, 1)
    unit = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(unit) / F.lit(float(leaf.weight))


def _earliest(nodes: list[tuple[int, Column]]) -> tuple[Column, Column]:
    """Name and draw of the earliest of some nodes; of equal draws the first node."""
    draw = F.least(*[d for _, d in nodes]) if len(nodes) > 1 else nodes[0][1]
    name = F.lit(nodes[-1][0])
    for n, d in reversed(nodes[:-1]):
        name = F.when(d == draw, F.lit(n)).otherwise(name)
    return name, draw


def descend(df: DataFrame, key: str, leaves: list[Leaf], name: str) -> DataFrame:
    """Add ``<name>_region``, ``<name>_rack`` and ``name``, the shard, of each row.

    Draws are computed once per row and climb the tree; the row then goes down it.
    """
    draws = {leaf.shard: F.col(f"_t{leaf.shard}") for leaf in leaves}
    df = df.withColumns({f"_t{x.shard}": _draw(F.col(key), x) for x in leaves})
    racks: dict[int, list[Leaf]] = {}
    regions: dict[int, set[int]] = {}
    for leaf in leaves:
        racks.setdefault(leaf.rack, []).append(leaf)
        regions.setdefault(leaf.region, set()).add(leaf.rack)
    in_rack = {r: _earliest([(x.shard, draws[x.shard]) for x in xs]) for r, xs in racks.items()}
    df = df.withColumns({f"_r{r}": draw for r, (_, draw) in in_rack.items()})
    in_region = {
        g: _earliest([(r, F.col(f"_r{r}")) for r in sorted(rs)]) for g, rs in regions.items()
    }
    df = df.withColumns({f"_g{g}": draw for g, (_, draw) in in_region.items()})
    df = df.withColumn(f"{name}_region", _earliest([(g, F.col(f"_g{g}")) for g in regions])[0])

    def down(level: Column, choices: dict) -> Column:
        picked = None
        for node, choice in choices.items():
            here = level == F.lit(node)
            picked = F.when(here, choice) if picked is None else picked.when(here, choice)
        return picked

    df = df.withColumn(
        f"{name}_rack", down(F.col(f"{name}_region"), {g: c for g, (c, _) in in_region.items()})
    )
    df = df.withColumn(name, down(F.col(f"{name}_rack"), {r: c for r, (c, _) in in_rack.items()}))
    scratch = [f"_t{x.shard}" for x in leaves] + [f"_r{r}" for r in racks]
    return df.drop(*scratch, *[f"_g{g}" for g in regions])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row by its doc_id, and the shard it has with one shard more.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack``.
    ``size`` is the number of UTF-8 bytes plus 1.  A null text has no bytes: size 1, checksum 0.
    Slots of a shard count from 0 without gaps, in the order of a hash of the doc_id; rows that
    share a doc_id follow each other by checksum and size.  A row without doc_id is placed
    as if its id were an empty string.  No rows give no rows; other columns are ignored.
    """
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        unit_hash(F.lit("slot"), key).alias("_order"),
        key.alias("_key"),
        F.lit(1).alias("_one"),
    )
    placed = descend(rows, "_key", tree(shards), "shard")
    # with one more shard: only its draw is new
    new = _draw(F.col("_key"), tree(shards + 1)[-1])
    old = F.least(*[_draw(F.col("_key"), x) for x in tree(shards)])
    grown = F.when(new < old, F.lit(shards)).otherwise(F.col("shard"))
    placed = placed.withColumn("grown_shard", grown.cast("int"))
    placed = materialise(placed, "placed")  # without texts, which are read once
    per_shard = -(-placed.count() // shards)
    order = ["_order", "doc_id", "text_crc32", "size"]
    slots = running(placed, ["shard"], order, hash_spot("_order"), "_one", "slot", per_shard)
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int"),
        "slot",
        "grown_shard",
        F.col("shard_region").cast("int").alias("region"),
        F.col("shard_rack").cast("int").alias("rack"),
    )
