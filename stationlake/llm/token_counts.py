"""Token counts of a piece model by merging whole arrays of pre-tokens, one rank at a time.

A text is cut wherever no piece of the model holds the two characters side by side, so no merge
reaches over a cut.  The pre-tokens of a batch lie one behind another in one array of symbols, equal
ones once.  In each round every pre-token applies its own lowest-ranked pair at all places where
it stands; pre-tokens without a pair leave with the number of symbols that survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import carried, slices
from stationlake.llm.pieces import (
    BPE,
    BYTE,
    CONTROL,
    MODEL_FILE,
    NORMAL,
    SPACE,
    UNKNOWN,
    PieceModel,
    build_tokenizer,
    parse_model,
    read_model,
)

#: Tokens a text may have before it counts as over the limit.
LIMIT = 4096

#: Text merged at once, in characters; arrays of a batch take about a hundred bytes for each.
WINDOW = 500_000

_NO_RANK = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class MergeTable:
    """A piece model as arrays.

    Symbols 0 to 3 are characters outside all pieces, of 1 to 4 bytes in UTF-8.
    """

    symbol_of: np.ndarray  # of a code point
    weight: np.ndarray  # tokens that a surviving symbol stands for
    beside: np.ndarray  # sorted keys of symbols that stand side by side in some piece
    pairs: np.ndarray  # sorted keys of mergeable pairs; rank and target have one entry more
    rank: np.ndarray
    target: np.ndarray

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) * len(self.weight) + right

    def slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs are in the table; its last entry for those that can't be merged."""
        key = self.key(left, right)
        at = np.searchsorted(self.pairs, key)
        found = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key
        return np.where(found, at, len(self.pairs))

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether some piece holds the two symbols, both characters, side by side."""
        key = self.key(left, right)
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        return self.beside[at] == key


def merge_table(model: PieceModel) -> MergeTable:
    kinds = {kind for _, _, kind in model.pieces}
    if model.kind != BPE or not model.byte_fallback or model.spaces_after or not model.escape_spaces:
        raise ValueError("only BPE models with byte pieces and the space mark before words")
    if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    scores = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    chars = sorted({c for p in scores for c in p} | {SPACE})
    names = [*scores, *(c for c in chars if c not in scores)]
    ids = {p: i + 4 for i, p in enumerate(names)}

    points = np.arange(0x110000)
    symbol_of = ((points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int32)
    symbol_of[[ord(c) for c in chars]] = [ids[c] for c in chars]
    symbol_of[ord(" ")] = ids[SPACE]
    weight = np.array([1, 2, 3, 4] + [1 if p in scores else len(p.encode()) for p in names])

    size = len(weight)
    beside = {ids[p[i]] * size + ids[p[i + 1]] for p in scores for i in range(len(p) - 1)}
    ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    rank_of = {p: ranks[s] for p, s in scores.items()}
    rows = [
        (ids[piece[:i]] * size + ids[piece[i:]], rank, ids[piece])
        for piece, rank in rank_of.items()
        for i in range(1, len(piece))
        if piece[:i] in ids and piece[i:] in ids
    ]
    rows = np.array(sorted(rows) or [(-1, _NO_RANK, 0)], np.int64)
    return MergeTable(
        symbol_of,
        weight,
        np.array(sorted(beside) or [-1], np.int64),
        rows[:, 0],
        np.append(rows[:, 1], _NO_RANK).astype(np.int32),
        np.append(rows[:, 2], 0).astype(np.int32),
    )


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])


def _undisturbed(table, symbols, owner, at, made, rank) -> np.ndarray:
    """Which merges come before any pair of the same or a lower rank that one of them brings about.

    Merges of a pre-token happen from the left; the one that first brings such a pair is the last.
    """
    here = owner[at]
    before = np.maximum(at - 1, 0)
    left = symbols[before]
    follows = np.r_[False, at[1:] == at[:-1] + 2]
    left = np.where(follows, np.r_[0, made[:-1]], left)
    after = np.minimum(at + 2, len(symbols) - 1)
    brings = (
        (table.rank[table.slot(left, made)] <= rank) & (owner[before] == here) & (at > 0)
    ) | (
        (table.rank[table.slot(made, symbols[after])] <= rank) & (owner[after] == here) & (after == at + 2)
    )
    earlier = np.cumsum(brings) - brings
    heads = _starts(here)
    return earlier == np.repeat(earlier[heads], np.diff(np.r_[heads, len(here)]))


def surviving(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each of the pre-tokens that lie one behind another in ``symbols``."""
    total = np.zeros(len(lengths), np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    none = len(table.pairs)
    slot = np.full(len(symbols), none)
    if len(symbols) > 1:
        slot[:-1] = table.slot(symbols[:-1], symbols[1:])
        slot[:-1][owner[1:] != owner[:-1]] = none
    while len(symbols):
        starts = _starts(owner)
        sizes = np.diff(np.r_[starts, len(owner)])
        rank = table.rank[slot]
        lowest = np.minimum.reduceat(rank, starts)
        live = lowest < _NO_RANK
        if not live.all():
            done = ~live
            total[owner[starts[done]]] = np.add.reduceat(table.weight[symbols], starts)[done]
            keep = np.repeat(live, sizes)
            symbols, owner, slot, rank = symbols[keep], owner[keep], slot[keep], rank[keep]
            lowest, sizes = lowest[live], sizes[live]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, sizes))
        # of pairs that overlap in a run, the first, the third and so on
        order = np.arange(len(at))
        begins = np.r_[True, at[1:] != at[:-1] + 1]
        at = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
        at = at[_undisturbed(table, symbols, owner, at, table.target[slot[at]], rank[at])]
        symbols[at] = table.target[slot[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, owner, slot = symbols[keep], owner[keep], slot[keep]
        at = at - np.arange(len(at))
        for left in (at, at[at > 0] - 1):
            right = np.minimum(left + 1, len(symbols) - 1)
            inside = (left < right) & (owner[left] == owner[right])
            slot[left] = np.where(inside, table.slot(symbols[left], symbols[right]), none)
    return total


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _count(table: MergeTable, parts: list[str]) -> np.ndarray:
    """Tokens of each part; parts are not empty and begin and end at cuts."""
    symbols = table.symbol_of[_codes("".join(parts))]
    n = len(symbols)
    heads = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
    cut = np.ones(n, bool)
    cut[1:] = ~table.joined(symbols[:-1], symbols[1:])
    cut[heads] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.r_[starts, n])
    spot = np.arange(n) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(lengths.max(), _MIX))
    digest = np.add.reduceat((symbols + 1).astype(np.uint64) * powers[spot], starts)
    _, one, same = np.unique(digest, return_index=True, return_inverse=True)
    # equal hashes count as equal only if the symbols are
    twin = np.minimum(np.repeat(starts[one][same], lengths) + spot, n - 1)
    if (lengths != lengths[one][same]).any() or (symbols != symbols[twin]).any():
        one = same = np.arange(len(starts))
    sizes = lengths[one]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    tokens = surviving(table, symbols[np.repeat(starts[one], sizes) + inner], sizes)[same]
    return np.add.reduceat(tokens, np.searchsorted(starts, heads))


def _parts(table: MergeTable, text: str, most: int) -> Iterator[str]:
    """A long text in parts of about ``most`` characters that end at cuts."""
    at, step = 0, most
    while len(text) - at > step:
        symbols = table.symbol_of[_codes(text[at : at + step + 1])]
        cuts = np.flatnonzero(~table.joined(symbols[:-1], symbols[1:]))
        if len(cuts):
            yield text[at : at + int(cuts[-1]) + 1]
            at, step = at + int(cuts[-1]) + 1, most
        else:
            step *= 2
    if at < len(text):
        yield text[at:]


class Counter:
    """Token counts of one model."""

    def __init__(self, data: bytes, window: int = WINDOW):
        model = parse_model(data)
        self.table, self.window = merge_table(model), window
        self.prefix = SPACE if model.dummy_prefix else ""
        plain = not model.charsmap and not model.strip_spaces
        self.normaliser = None if plain else build_tokenizer(model).normalizer

    def normal(self, text: str) -> str:
        if not text:
            return ""
        return self.prefix + text if self.normaliser is None else self.normaliser.normalize_str(text)

    def count(self, texts: list[str]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owners: list[int] = []
        size = 0

        def flush():
            nonlocal size
            if parts:
                np.add.at(totals, owners, _count(self.table, parts))
            parts.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in _parts(self.table, self.normal(text), self.window):
                parts.append(part)
                owners.append(i)
                size += len(part)
                if size >= self.window:
                    flush()
        flush()
        return totals


@lru_cache(maxsize=4)
def counter(data: bytes) -> Counter:
    return Counter(data)


def _count_tokens(batches, data: bytes, limit: int, carry: list[str]):
    for whole in batches:
        for batch in slices(whole, "_text"):
            texts = batch.column("_text")
            tokens = counter(data).count([x or "" for x in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry]
                + [
                    pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array(tokens > limit, pa.bool_()),
                ],
                carry + ["n_bytes", "n_tokens", "over_limit"],
            )


def count_tokens(
    docs: DataFrame, carry: list[str], model_file: str = MODEL_FILE, limit: int = LIMIT
) -> DataFrame:
    """The columns ``carry`` of ``docs`` and the tokens of every whole text.

    ``n_bytes`` is the text's length in UTF-8, ``n_tokens`` the number of pieces that SentencePiece
    gives without begin or end, ``over_limit`` whether they are more than ``limit``.  A null or empty
    text has none of both.  A long text is merged in parts that end where no piece can lie, so memory
    stays bounded unless it has no such place.  Each row stands alone: repeated rows get equal results,
    no rows give no rows.  Columns not carried are ignored, one named like a result is left out.
    """
    carry, ddl = carried(docs, carry, {"n_bytes", "n_tokens", "over_limit", "_text"})
    taken = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("_text")
    )
    return taken.mapInArrow(
        partial(_count_tokens, data=read_model(model_file), limit=limit, carry=carry),
        ddl + "n_bytes long, n_tokens long, over_limit boolean",
    )
