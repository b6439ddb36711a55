"""Order-dependent work without one task per station.

A window partitioned by station alone sends a whole station to one task.  Here a
frame is first *laid out*: sorted once by range over the cluster and numbered, so
that every row knows its 0-based position in its series.  Order-dependent
expressions then run on blocks of consecutive positions:

* bounded frames (``rows between b preceding and a following``) get copies of the
  ``b`` rows before and the ``a`` rows after a block (`Blocks`);
* "nearest earlier / later value" needs no frame: each block contributes its outer
  values to a small table, which is carried from block to block (`neighbours`).

Both give the result of the station-wide window, whatever the size of a station.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stationlake.session import materialise, scratch_path

POS = "series_pos"
SIZE = "series_rows"
BLOCK = "series_block"
BLOCK_ROWS = 1 << 18


def attach(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Bring the columns of a per-key table to every row of ``df``.

    No broadcast is forced: the table grows with the number of keys, so Spark
    decides from its measured size, and otherwise splits a hot key at run time.
    """
    if not keys:
        # a table without keys is one row by construction
        return df.crossJoin(F.broadcast(small))
    renamed = small.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
    )
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    return df.join(renamed, match, how).drop(*[f"__{k}" for k in keys])


def attach_stored(
    df: DataFrame, small: DataFrame, keys: list[str], how: str = "left"
) -> DataFrame:
    """`attach` for a table with few rows per key, such as means per station.

    The table is written first.  Spark then knows its size when it plans the join: a
    small one is broadcast and ``df`` is not shuffled at all, a large one is not.
    """
    return attach(df, materialise(small, "keys"), keys, how)


def lay_out(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    weight: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Number the rows of each series by ``order``; adds ``series_pos`` and ``series_rows``.

    ``order`` must end in a column that is unique within the series.  The rows are
    written once, sorted, to the shared scratch folder, so that the numbering is
    fixed and survives lost executors.  Range partitioning on keys *and* order
    splits a hot series over many tasks.

    With ``weight`` a row stands for that many equal rows: ``series_pos`` is then
    the position of the first of them.
    """
    spark = df.sparkSession
    by = [*keys, *order]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *by)
    tagged = ranged.sortWithinPartitions(*by).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_row"),
    )
    path = scratch_path(spark, "series")
    tagged.write.parquet(path)
    stored = spark.read.schema(tagged.schema).parquet(path)

    amount = F.col(weight) if weight else F.lit(1)
    runs = stored.groupBy(*keys, "_part").agg(
        F.min("_row").alias("_first"), F.sum(amount).cast("long").alias("_amount")
    )
    # one row per (series, part): a series has at most as many as there are parts
    earlier = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    runs = runs.select(
        *keys,
        "_part",
        "_first",
        (F.sum("_amount").over(earlier) - F.col("_amount")).alias("_before"),
        F.sum("_amount").over(Window.partitionBy(*keys)).alias(SIZE),
    )
    placed = attach_stored(stored, runs, [*keys, "_part"])
    if weight:
        in_part = Window.partitionBy(*keys, "_part").orderBy("_row")
        offset = F.sum(amount).over(in_part) - amount
    else:
        offset = F.col("_row") - F.col("_first")
    return placed.withColumn(POS, (offset + F.col("_before")).cast("long")).drop(
        "_part", "_row", "_first", "_before"
    )


@dataclass(frozen=True)
class Blocks:
    """Rows of laid-out series in blocks, with copies around each block.

    ``with_columns`` may be chained; a value that depends on ``b`` rows before is
    right for the rows of the block itself as long as the sum of all frames stays
    within ``before`` and ``after``.
    """

    df: DataFrame
    keys: tuple[str, ...]
    block_rows: int

    @staticmethod
    def of(
        df: DataFrame,
        keys: list[str],
        before: int = 0,
        after: int = 0,
        block_rows: int = BLOCK_ROWS,
    ) -> Blocks:
        first = F.expr(f"greatest({POS} - {after}, 0L) div {block_rows}L")
        last = F.expr(f"({POS} + {before}) div {block_rows}L")
        if before == 0 and after == 0:
            spread = df.withColumn(BLOCK, F.expr(f"{POS} div {block_rows}L"))
        else:
            spread = df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
        return Blocks(spread, tuple(keys), block_rows)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(POS)

    @property
    def reverse(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(F.col(POS).desc())

    def with_columns(self, columns: dict[str, Column]) -> Blocks:
        return Blocks(self.df.withColumns(columns), self.keys, self.block_rows)

    def home(self) -> DataFrame:
        """The rows themselves, without the copies."""
        at_home = F.expr(f"{POS} div {self.block_rows}L") == F.col(BLOCK)
        return self.df.filter(at_home).drop(BLOCK)


def over_rows(
    df: DataFrame,
    keys: list[str],
    before: int,
    after: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the columns ``build(window)`` whose frames reach ``before`` / ``after`` rows."""
    blocks = Blocks.of(df, keys, before, after, block_rows)
    return blocks.with_columns(build(blocks.window)).home()


def neighbours(
    df: DataFrame, keys: list[str], columns: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Nearest non-null value at or before, and at or after, each row.

    Adds ``prev_pos_c, prev_c, next_pos_c, next_c`` for each column ``c``.
    """
    blocks = Blocks.of(df, keys, block_rows=block_rows)
    outer = []
    for c in columns:
        seen = F.when(F.col(c).isNotNull(), F.col(POS))
        outer += [
            F.max(seen).alias(f"_last_pos_{c}"),
            F.max_by(c, seen).alias(f"_last_{c}"),
            F.min(seen).alias(f"_first_pos_{c}"),
            F.min_by(c, seen).alias(f"_first_{c}"),
        ]
    # one row per block
    edges = blocks.df.groupBy(*keys, BLOCK).agg(*outer)
    behind = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        Window.partitionBy(*keys)
        .orderBy(F.col(BLOCK).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = edges.select(
        *keys,
        BLOCK,
        *[
            F.last(f"_last_{part}{c}", ignorenulls=True).over(behind).alias(f"_in_{part}{c}")
            for c in columns
            for part in ("pos_", "")
        ],
        *[
            F.last(f"_first_{part}{c}", ignorenulls=True).over(ahead).alias(f"_out_{part}{c}")
            for c in columns
            for part in ("pos_", "")
        ],
    )
    # the carried values enter a block as one row before and one row after its rows,
    # so that no join is needed and the readings are shuffled once
    sides = {"in": F.col(BLOCK) * block_rows - 1, "out": (F.col(BLOCK) + 1) * block_rows}
    rows = blocks.df.withColumns(
        {
            "_edge": F.lit(False),
            **{f"_seen_{c}": F.when(F.col(c).isNotNull(), F.col(POS)) for c in columns},
        }
    )
    for side, at in sides.items():
        edge = carried.select(
            *keys,
            BLOCK,
            at.alias(POS),
            F.lit(True).alias("_edge"),
            *[F.col(f"_{side}_{c}").alias(c) for c in columns],
            *[F.col(f"_{side}_pos_{c}").alias(f"_seen_{c}") for c in columns],
        )
        rows = rows.unionByName(edge, allowMissingColumns=True)
    joined = Blocks(rows, tuple(keys), block_rows)
    start = Window.unboundedPreceding
    near = {}
    for name, window in (("prev", joined.window), ("next", joined.reverse)):
        for c in columns:
            so_far = window.rowsBetween(start, 0)
            near[f"{name}_pos_{c}"] = F.last(f"_seen_{c}", ignorenulls=True).over(so_far)
            near[f"{name}_{c}"] = F.last(c, ignorenulls=True).over(so_far)
    return (
        joined.with_columns(near)
        .df.filter(~F.col("_edge"))
        .drop(BLOCK, "_edge", *[f"_seen_{c}" for c in columns])
    )


#: Cells a bracket is cut into; a bracket has at most one row more than these per round.
CELLS = 65_536


def exact_quantiles(
    df: DataFrame, keys: list[str], column: str, levels: dict[str, float]
) -> DataFrame:
    """Linear-interpolation quantiles per series: one column per entry of ``levels``.

    Equal values are counted first and nothing is sorted: each order statistic starts with the bracket
    from the smallest to the largest value, which is cut into cells; the cell that holds its rank,
    with the values it really has, is the next bracket, until a bracket is a single value.
    """
    counts = materialise(
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w")),
        "values",
    )
    spans = materialise(
        counts.groupBy(*keys).agg(
            F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        ),
        "spans",
    )
    endless = F.isnan("_hi") | (F.abs("_hi") == float("inf")) | (F.abs("_lo") == float("inf"))
    if not spans.where(endless).isEmpty():
        return _sorted_quantiles(counts, keys, levels)
    targets = []
    for name, level in levels.items():
        at = F.lit(float(level)) * (F.col("_n") - 1)
        targets += [
            F.struct(F.lit(f"{side}_{name}").alias("_target"), rank.cast("long").alias("_rank"))
            for side, rank in (("_lo", F.floor(at)), ("_hi", F.ceil(at)))
        ]
    brackets = spans.select(
        *keys, "_n", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.inline(F.array(*targets))
    )
    found = []
    while True:
        brackets = materialise(brackets, "brackets")
        found.append(brackets.where("_lo = _hi"))
        open_ = brackets.where("_lo < _hi")
        if open_.isEmpty():
            break
        brackets = _narrowed(counts, open_, keys)
    picked = reduce(DataFrame.unionByName, found)
    sides = [F.max(F.when(F.col("_target") == f"{s}_{n}", F.col("_lo"))).alias(f"{s}_{n}") for n in levels for s in ("_lo", "_hi")]
    grouped = picked.groupBy(*keys).agg(F.max("_n").alias("_n"), *sides)
    return grouped.select(*keys, *_between(levels))


def _narrowed(counts: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Each bracket cut down to the cell that holds its rank."""
    v, low, high = F.col("_v"), F.col("_lo"), F.col("_hi")
    # halves, so that the width of a bracket does not overflow; its ends lie in different cells
    part = (v / 2 - low / 2) / (high / 2 - low / 2)
    cells = (
        attach(counts, brackets, keys, "inner")
        .where(v.between(low, high))
        .groupBy(*keys, "_target", "_n", "_rank", "_below", F.floor(part * CELLS).cast("int").alias("_cell"))
        .agg(F.sum("_w").alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    # a series has at most ``CELLS + 1`` rows here for each order statistic
    upto = Window.partitionBy(*keys, "_target").orderBy("_cell")
    before = F.col("_below") + F.sum("_w").over(upto) - F.col("_w")
    return (
        cells.withColumn("_before", before)
        .where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_w")))
        .select(*keys, "_n", "_lo", "_hi", F.col("_before").cast("long").alias("_below"), "_target", "_rank")
    )


def _between(levels: dict[str, float]) -> list[Column]:
    """The quantiles from the order statistics at both sides."""
    out = []
    for name, level in levels.items():
        at = float(level) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return out


def _sorted_quantiles(counts: DataFrame, keys: list[str], levels: dict[str, float]) -> DataFrame:
    """The same by numbering the distinct values: the way for series with endless values."""
    laid = lay_out(counts, keys, ["_v"], weight="_w")
    picks = []
    for name, level in levels.items():
        at = F.lit(float(level)) * (F.col(SIZE) - 1)
        for side, rank in (("_lo", F.floor(at)), ("_hi", F.ceil(at))):
            covers = (F.col(POS) <= rank) & (rank < F.col(POS) + F.col("_w"))
            picks.append(F.max(F.when(covers, F.col("_v"))).alias(f"{side}_{name}"))
    grouped = laid.groupBy(*keys).agg(F.max(SIZE).alias("_n"), *picks)
    return grouped.select(*keys, *_between(levels))
