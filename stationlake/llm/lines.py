"""Line deduplication: lines that many documents share stay in one of them.

Only DataFrame functions run.  A line is known by two 64-bit hashes of its key, so texts
are shuffled once, when the positions of the lines to drop come back to their documents.
The work grows with the number of lines, also within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import SPACES, lower_ascii, packed, unpacked
from stationlake.session import materialise

LEAST_CHARS, LEAST_DOCS = 40, 5


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _hash(key: Column) -> list[Column]:
    """128 bits, as two independent hashes of 64."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), F.reverse(key)).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _long_lines(text: Column, least_chars: int) -> Column:
    """Hash, position and whether it is the first with its hash, of each line with a long key."""
    keyed = F.transform(_lines(text), lambda line, i: F.struct(_key(line).alias("key"), i.alias("pos")))
    long = F.filter(keyed, lambda x: F.char_length(x["key"]) >= least_chars)
    hashed = F.sort_array(F.transform(long, lambda x: F.struct(*_hash(x["key"]), x["pos"].alias("pos"))))

    def flagged(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(all_, i - 1)
            again = (before["h1"] == x["h1"]) & (before["h2"] == x["h2"])
            return F.struct(
                x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"),
                (~F.coalesce(again, F.lit(False))).alias("first"),
            )

        return F.transform(all_, one)

    # the outer transform binds the sorted array, so that it is not made again for each line
    return F.transform(F.array(hashed), flagged)[0]


def _without(split: Column, drop: Column) -> Column:
    """The lines but those at the positions to drop, which are sorted."""

    def stays(bounds: Column) -> Column:
        # true for the lines between two positions, false for the one at the second
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(bounds) - 1),
                lambda k: F.concat(
                    F.array_repeat(F.lit(True), bounds[k] - bounds[k - 1] - 1), F.array(F.lit(False))
                ),
            )
        )

    bounds = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(split)))
    flags = F.transform(F.array(bounds), stays)
    # bound by a transform each, so that neither array is made again for each line
    return F.transform(flags, lambda f: F.filter(split, lambda _, i: F.get(f, i)))[0]


def dedup_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """``docs`` with the columns ``n_lines``, ``n_dropped`` and ``kept_text``.

    Texts are split at newlines.  The key of a line is the line without ASCII white space at
    its ends and with A-Z in lower case.  A key of at least ``least_chars`` characters
    found in at least ``least_docs`` documents loses its lines in all of them except the one
    with the largest doc_id; within that document all its lines stay.

    A null or empty text is one empty line and gives an empty text.  Rows with equal doc_id
    each count as a document, and all of them may be the largest.  A row without doc_id
    counts and is never the largest.  Input columns named like the three results are replaced.
    """
    # rows may share a doc_id: the text's hash tells them apart, and spreads those without one
    told = F.xxhash64("text")
    # hashed below the generator, where it is done once for each text and not for each line
    texts = docs.select("doc_id", told.alias("told"), F.col("text").alias("t"))
    lines = materialise(
        texts.select("doc_id", "told", F.inline(_long_lines(F.col("t"), least_chars))), "lines"
    )
    # written, so that its size is known and a join may split a line that many documents have
    common = materialise(
        lines.where("first")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .where(F.col("n") >= least_docs)
        .select("h1", "h2", "last"),
        "common",
    )
    drops = (
        lines.join(common, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("told").alias("_told"))
        .agg(F.sort_array(F.collect_set("pos")).alias("_drop"))
    )
    joined = docs.drop("_id", "_told", "_drop", "_split", "_kept").join(
        drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (told == F.col("_told")), "left"
    )
    split = F.col("_split")
    return (
        joined.withColumn("_split", _lines(F.col("text")))
        .withColumn("_kept", F.when(F.col("_drop").isNull(), split).otherwise(_without(split, F.col("_drop"))))
        .withColumn("n_lines", F.size("_split").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long"))
        .withColumn("kept_text", F.array_join("_kept", "\n"))
        .drop("_id", "_told", "_drop", "_split", "_kept")
    )


def without_common_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with shortened texts; only lost lines change a text, and n_chars follows."""
    row = F.col("_row")
    found = dedup_lines(
        packed(docs).withColumns({"doc_id": row.getField("doc_id"), "text": row.getField("text")})
    )
    changed = F.col("n_dropped") > 0
    columns = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.char_length("kept_text").cast(kind)).otherwise(
            row.getField("n_chars")
        )
    return unpacked(found, docs.columns, **columns)
