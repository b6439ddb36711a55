"""Mixing sources to target weights by a low-discrepancy schedule.

Points of the golden-ratio sequence, mapped through the cumulative targets, say which
source fills each slot of the mix.  The r-th slot of a source takes the r-th block of that
source's words: its documents in a hashed order, then all of them again in another order,
cut into blocks of equally many words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.llm.common import packed, running, unpacked
from stationlake.session import materialise

GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"
#: Cells that the range of all words is cut into, to find a slot's source by equality.
CELLS = 4096


@dataclass(frozen=True)
class Mixture:
    """Weights by the rank of a source, size of the mix, passes over a source, slots."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    passes: int = 2
    slots: int = 1 << 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """``source, source_size, target`` per source of ``rows (source, size)``.

    Sources that reach their cap are those with the smallest cap per weight; the level that
    the others share follows from running totals in that order: it falls after the first source
    below its cap, so it is the largest among those.  One row per source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in mixture.weights])
    per = per.withColumn("weight", F.element_at(weights, rank % len(mixture.weights) + 1))
    per = per.withColumn("cap", F.lit(float(mixture.passes)) * F.col("source_size"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumns(
        {
            "_total": F.lit(mixture.share) * F.sum("source_size").over(everything),
            "_weights": F.sum("weight").over(everything),
            "_caps": F.sum("cap").over(by_cap) - F.col("cap"),
            "_used": F.sum("weight").over(by_cap) - F.col("weight"),
        }
    )
    level = (F.col("_total") - F.col("_caps")) / (F.col("_weights") - F.col("_used"))
    per = per.withColumn("_level", level)
    free = F.col("cap") / F.col("weight") >= F.col("_level")
    per = per.withColumn("_shared", F.max(F.when(free, F.col("_level"))).over(everything))
    target = F.least(F.col("cap"), F.col("weight") * F.col("_shared"))
    return per.select("source", "source_size", F.coalesce(target, "cap").alias("target"))


def schedule(goals: DataFrame, mixture: Mixture) -> tuple[DataFrame, int]:
    """``slot, source, block`` of the mix, and the words of a block."""
    spark = goals.sparkSession
    goal = goals.withColumn("goal", F.round("target").cast("long"))
    total = goal.agg(F.sum("goal")).first()[0] or 0
    words = max(1, -(-total // mixture.slots))
    count = -(-total // words)
    ends = goal.where("goal > 0").withColumn(
        "end", F.sum("goal").over(Window.orderBy(F.col("source").asc_nulls_last()))
    )
    ranges = ends.select(
        "source", "end", (F.col("end") - F.col("goal")).alias("begin")
    ).withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.expr(f"begin * {CELLS} div {max(1, total)}"),
                F.expr(f"(end - 1) * {CELLS} div {max(1, total)}"),
            )
        ),
    )
    turn = (F.col("id") + 0.5) * GOLDEN
    slots = (
        spark.range(count)
        .withColumn("at", F.floor((turn - F.floor(turn)) * float(total)))
        .withColumn("cell", F.expr(f"at * {CELLS} div {max(1, total)}"))
    )
    placed = materialise(
        slots.join(ranges, "cell")
        .where("at >= begin and at < end")
        .select(F.col("id").alias("slot"), "source", F.lit(1).alias("one")),
        "slots",
    )
    spot = F.col("slot") / F.lit(float(max(1, count)))
    ranked = running(placed, ["source"], ["slot"], spot, "one", "block", count)
    return ranked.select("slot", "source", "block"), words


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size``; the numbers are fixed by writing them."""
    return materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
        ),
        "rows",
    )


def mix(rows: DataFrame, mixture: Mixture) -> tuple[DataFrame, DataFrame]:
    """Targets of the sources of ``rows``, and the pieces of the mix.

    Pieces are ``slot, row, pass, first, words``: slot ``slot`` takes ``words`` words of the
    row from its word ``first`` on.
    """
    goals = materialise(targets(rows, mixture), "targets")
    slots, block = schedule(goals, mixture)
    copies = rows.where("size > 0").select(
        "row", "doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.lit(mixture.passes))).alias("pass")
    )
    key = F.concat_ws(":", F.col("pass"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    copies = materialise(copies.withColumn("key", F.md5(key)), "copies")
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = running(
        copies, ["source", "pass"], ["key", "size", "row"], spot, "size", "offset", rows.count()
    )
    sized = goals.select(F.col("source").alias("_source"), "source_size")
    begin = F.col("offset") + (F.col("pass") - 1) * F.col("source_size")
    placed = (
        placed.join(sized, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("begin", begin)
        .withColumn("end", F.col("begin") + F.col("size"))
        .drop("_source")
    )
    cut = placed.withColumn(
        "block", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})"))
    )
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("end"), (F.col("block") + 1) * block)
    cut = cut.select(
        F.col("source").alias("_source"),
        F.col("block").alias("_block"),
        "row",
        "pass",
        (low - F.col("begin")).alias("first"),
        (high - low).alias("words"),
    )
    same = (F.col("block") == F.col("_block")) & F.col("source").eqNullSafe(F.col("_source"))
    pieces = slots.join(cut, same).select("slot", "row", "pass", "first", "words")
    return goals, pieces


def mixture_report(docs: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """What the mix takes of every row: ``doc_id, size, source_size, target, taken``.

    ``size`` counts words (null text: 0).  ``target`` is the goal of the row's source, ``taken`` the
    words of the row in the mix, at most ``passes`` times its size.  A null source is
    a source, last in order.  A source ends within a few blocks (each about 1/131072 of the
    mix) of its target.  Rows without words take 0.  Rows that share a doc_id each count,
    next to each other in the hashed order.  No rows give no rows; other columns are ignored.
    """
    rows = numbered(docs)
    goals, pieces = mix(rows, mixture or Mixture())
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    goals = goals.withColumnRenamed("source", "_source")
    return (
        rows.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .join(taken, "row", "left")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, mixture: Mixture | None = None) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row per row and pass that it takes.

    Rows with words of which the mix takes none go; a row taken twice appears twice.  The one row
    at a source's end that is taken in part keeps the words taken, with their spaces.
    Rows without words take no room and stay once.
    """
    # rows are known by two hashes and their number among equal rows, so that no text is stored
    # to keep a row number; texts are shuffled once
    field = F.col("_row").getField
    said = [field("doc_id"), field("source"), field("text")]
    whole = packed(docs).withColumns(
        {"_k1": F.xxhash64(*said), "_k2": F.xxhash64(F.lit(7), *reversed(said))}
    )
    rows = (
        whole.select("_k1", "_k2", *[x.alias(n) for x, n in zip(said, ("doc_id", "source", "text"))])
        .groupBy("_k1", "_k2", "doc_id", "source", n_words(F.col("text")).alias("size"))
        .agg(F.count(F.lit(1)).cast("int").alias("equal"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("equal"))))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = materialise(rows, "rows")
    _, pieces = mix(rows.select("row", "doc_id", "source", "size"), mixture or Mixture())
    taken = pieces.groupBy("row", "pass").agg(F.sum("words").alias("_words"))
    known = [F.col("_k1").alias("_c1"), F.col("_k2").alias("_c2"), "nth", "_words", "size"]
    chosen = taken.join(rows, "row").select(*known)
    empty = rows.where("size = 0").withColumn("_words", F.lit(0).cast("long")).select(*known)
    equal_rows = Window.partitionBy("_k1", "_k2").orderBy("_k1")
    same = (
        (F.col("_k1") == F.col("_c1"))
        & (F.col("_k2") == F.col("_c2"))
        & (F.col("_nth") - F.col("nth") == 0)
    )
    mixed = whole.withColumn("_nth", F.row_number().over(equal_rows)).join(
        chosen.union(empty), same
    )
    whole_row = F.col("_words") == F.col("size")
    parts = F.regexp_extract_all(
        field("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)
    )
    text = F.when(whole_row, field("text")).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.col("_words").cast("int")), "")
    )
    columns = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(whole_row, field("n_chars")).otherwise(
            F.char_length(text).cast(kind)
        )
    return unpacked(mixed, docs.columns, **columns)
