"""Quality rules: counts of a text and bands for its zstandard compression ratio.

Repetitive text compresses far below prose of its length, random text far above.  How far
prose compresses depends on its length, so whole texts have limits per length; chunks of
one fixed size have one pair of limits, which finds a bad stretch inside a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import SPACES, carried, slices, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size in bytes, ends included.

    ``whole``: (least bytes, lowest ratio, highest ratio), the last row that fits counts.  The lowest
    lie below those of natural prose, cut to that length, in books and legal texts; they fall up
    to 3.3 MB, as level 3 finds repeated strings within 2 MiB.  ``chunk_share``: the part of
    chunks that may be outside ``chunk``; a last piece under half a chunk joins the chunk before.

    A character of several bytes repeats its lead bytes, so prose in such scripts compresses further in
    bytes and less far in characters.  Beyond ``plain_width`` bytes a character on average, the lowest
    limits are divided by how many times as wide a text is, and the highest rise by ``wide_rise``.

    Symbols between words of junk compress about as far as natural prose: texts with over
    ``symbol_share`` of them among their characters have the narrower ``symbol_whole`` and ``symbol_chunk``.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (100, 0.50, 1.15),
        (200, 0.45, 0.95),
        (283, 0.45, 0.90),
        (400, 0.44, 0.82),
        (566, 0.42, 0.80),
        (800, 0.41, 0.72),
        (1131, 0.40, 0.70),
        (1600, 0.38, 0.64),
        (2263, 0.36, 0.62),
        (3200, 0.34, 0.60),
        (4525, 0.33, 0.58),
        (6400, 0.32, 0.56),
        (12800, 0.30, 0.54),
        (25600, 0.295, 0.52),
        (51200, 0.29, 0.52),
        (102400, 0.28, 0.52),
        (204800, 0.27, 0.52),
        (409600, 0.26, 0.52),
        (819200, 0.25, 0.52),
        (1638400, 0.24, 0.52),
        (3276800, 0.23, 0.52),
    )
    symbol_whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (100, 0.59, 1.15),
        (200, 0.57, 0.95),
        (283, 0.54, 0.90),
        (400, 0.54, 0.82),
        (566, 0.50, 0.80),
        (800, 0.48, 0.72),
        (1131, 0.465, 0.70),
        (1600, 0.447, 0.64),
        (2263, 0.437, 0.62),
        (3200, 0.425, 0.60),
        (4525, 0.417, 0.58),
        (6400, 0.402, 0.56),
        (12800, 0.390, 0.54),
        (25600, 0.380, 0.52),
        (51200, 0.370, 0.52),
        (102400, 0.360, 0.52),
        (204800, 0.350, 0.52),
        (409600, 0.340, 0.52),
        (819200, 0.330, 0.52),
        (1638400, 0.320, 0.52),
        (3276800, 0.310, 0.52),
    )
    symbol_share: float = 0.05
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.33, 0.60)
    symbol_chunk: tuple[float, float] = (0.41, 0.60)
    chunk_share: float = 0.2
    plain_width: float = 1.25
    wide_rise: float = 0.08
    level: int = 3


def _ratio(packer: zstandard.ZstdCompressor, data: bytes) -> float:
    return len(packer.compress(data)) / len(data) if data else 0.0


def compression(
    data: bytes, bands: Bands, packer: zstandard.ZstdCompressor, symbols: bool = False, width: float = 1.0
):
    """Ratio of the whole, chunks, chunks outside their limits, verdict.

    By the limits for ``symbols`` or for other texts, at ``width`` bytes a character.
    """
    limits, chunk = (
        (bands.symbol_whole, bands.symbol_chunk) if symbols else (bands.whole, bands.chunk)
    )
    whole = _ratio(packer, data)
    wide = max(1.0, width / bands.plain_width)
    rise = bands.wide_rise * (wide - 1)
    low, high = [(b[1] / wide, b[2] + rise) for b in limits if len(data) >= b[0]][-1]
    chunk = (chunk[0] / wide, chunk[1] + rise)
    passes = low <= whole <= high
    count = max(1, (len(data) + bands.chunk_bytes // 2) // bands.chunk_bytes)
    outside = 0
    if len(data) >= bands.chunk_bytes:
        ends = [bands.chunk_bytes * i for i in range(count)] + [len(data)]
        for a, b in zip(ends, ends[1:]):
            outside += not chunk[0] <= _ratio(packer, data[a:b]) <= chunk[1]
    return whole, count, outside, passes and outside <= bands.chunk_share * count


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    windows = np.zeros(n, np.uint64)
    for i in range(width):
        windows = (windows ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(32)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.nonzero(twice)[0], 1)
    np.add.at(edges, np.nonzero(twice)[0] + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


_OUT = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
    ("ratio", pa.float64()),
    ("n_chunks", pa.int64()),
    ("n_chunks_outside", pa.int64()),
]
_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_outside long"
)


def verdict(text: str, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """The results of one text, in the order of `_OUT`."""
    found = counts(text)
    failed = found[0] < 10 or 100 * found[4] > 20 * found[0]
    data = text.encode("utf-8", "surrogatepass")
    symbols = found[2] > bands.symbol_share * found[1]
    width = len(data) / max(1, len(text))
    ratio, chunks, outside, passes = compression(data, bands, packer, symbols, width)
    return (*found, failed, passes and not failed, ratio, chunks, outside)


def _judge(batches, bands: Bands, carry: list[str]):
    packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
    for whole in batches:
        for batch in slices(whole, "_text"):
            rows = [verdict(x or "", bands, packer) for x in batch.column("_text").to_pylist()]
            columns = list(zip(*rows)) or [[]] * len(_OUT)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry]
                + [pa.array(c, kind) for c, (_, kind) in zip(columns, _OUT)],
                carry + [name for name, _ in _OUT],
            )


def judge(docs: DataFrame, carry: list[str], bands: Bands | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` and, of each whole text, counts and verdict.

    A null or empty text has no words and fails.  ``kept`` is false for texts under ten words, for
    those with over 20 % repeated words, and for those outside the compression bands.  Rows
    are judged one by one, so repeated rows get equal results; no rows give no rows; columns not
    carried are ignored, and one named like a result is left out.
    """
    carry, ddl = carried(docs, carry, {"_text", *(name for name, _ in _OUT)})
    taken = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("_text")
    )
    return taken.mapInArrow(partial(_judge, bands=bands or Bands(), carry=carry), ddl + _DDL)


def keep_good(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, that the rules keep; only texts go to Python."""
    bands = bands or Bands()

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        for texts in batches:
            yield pd.Series([verdict(x or "", bands, packer)[6] for x in texts], dtype=bool)

    return docs.where(good(F.col("text").cast("string")))
