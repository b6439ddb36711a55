"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field; its normaliser, metaspace marker, scores
and byte fallback are rebuilt as a `tokenizers` pipeline.  A unigram model keeps its
scores; a BPE model has no merge list, so the merges are the ways to make a piece of two
pieces, by falling score.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import carried, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"

#: Text encoded at once, in bytes; ids and what the libraries keep take a hundred times as much.
ENCODED_CHARS = 300_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """Number and value of each field of a protobuf message; messages stay bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"field kind {kind} in a model file")
        yield tag >> 3, value


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True
    spaces_after: bool = False


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in fields(data):
        if number == 1:  # a piece
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:  # the trainer's settings
            for n, v in fields(value):
                if n == 3:
                    model.kind = v
                elif n == 24:
                    model.spaces_after = bool(v)
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
        elif number == 3:  # the normaliser
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.dummy_prefix = bool(v)
                elif n == 4:
                    model.strip_spaces = bool(v)
                elif n == 5:
                    model.escape_spaces = bool(v)
    return model


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; of one piece, first pairs first."""
    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    ways = []
    for piece, score, kind in model.pieces:
        if kind not in (NORMAL, USER_DEFINED) or len(piece) < 2:
            continue
        own = [
            (ids[piece[:i]], ids[piece[i:]])
            for i in range(1, len(piece))
            if piece[:i] in ids and piece[i:] in ids
        ]
        ways += [(-score, *pair) for pair in sorted(own)]
    ways.sort(key=lambda w: w[0])
    return [(model.pieces[a][0], model.pieces[b][0]) for _, a, b in ways]


def build_tokenizer(model: PieceModel):
    """A `tokenizers.Tokenizer` that gives the ids of the SentencePiece model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.spaces_after or not model.escape_spaces:
        raise ValueError("models that put the space mark after words are not supported")
    names = [p for p, _, _ in model.pieces]
    if model.kind == UNIGRAM:
        core = models.Unigram(
            [(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback
        )
    elif model.kind == BPE:
        core = models.BPE(
            {p: i for i, p in enumerate(names)},
            merges(model),
            unk_token=names[model.unk_id],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.kind} is not supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    steps.append(normalizers.Replace(" ", SPACE))
    out.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names):
        # no piece reaches over the start of a word, so each word is encoded by itself
        word = Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        out.pre_tokenizer = pre_tokenizers.Split(word, "isolated")
    back = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(back)
    return out


class PieceTokenizer:
    """Ids and texts of one model, batch by batch."""

    def __init__(self, data: bytes):
        model = parse_model(data)
        self.backend = build_tokenizer(model)
        self.marked = model.dummy_prefix
        self.bytes = [self._bytes(i, *piece, model.unk_id) for i, piece in enumerate(model.pieces)]

    @staticmethod
    def _bytes(i: int, piece: str, score: float, kind: int, unk_id: int) -> bytes:
        if i == unk_id:
            return " \u2047 ".encode()
        if kind == CONTROL:
            return b""
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Bytes of the pieces, byte pieces included, without the space put before the text."""
        joined = [b"".join(map(self.bytes.__getitem__, x)) for x in ids]
        if self.marked:
            joined = [x.removeprefix(b" ") for x in joined]
        return [x.decode("utf-8", "replace") for x in joined]


@lru_cache(maxsize=4)
def tokenizer(data: bytes) -> PieceTokenizer:
    return PieceTokenizer(data)


@lru_cache(maxsize=4)
def _sentencepiece(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def read_model(path: str) -> bytes:
    """The model file, about half a megabyte; it goes to the tasks with the query."""
    with open(path, "rb") as f:
        return f.read()


def _encode(batches, data: bytes, threads: int, carry: list[str]):
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    pieces = tokenizer(data)
    for whole in batches:
        for batch in slices(whole, "_text", ENCODED_CHARS):
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            ids = pieces.encode(texts)
            theirs = _sentencepiece(data).encode(texts, num_threads=threads)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry]
                + [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([a == b for a, b in zip(texts, pieces.decode(ids))], pa.bool_()),
                    pa.array([a == b for a, b in zip(ids, theirs)], pa.bool_()),
                ],
                carry + ["n_tokens", "ids", "round_trip", "parity"],
            )


def _decode(batches, data: bytes, carry: list[str]):
    for batch in batches:
        ids = [x or [] for x in batch.column("_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in carry]
            + [pa.array(tokenizer(data).decode(ids), pa.string())],
            carry + ["text"],
        )


def encode(
    docs: DataFrame, carry: list[str], model_file: str = MODEL_FILE, threads: int | None = None
) -> DataFrame:
    """The columns ``carry`` of ``docs`` and the pieces of every whole text.

    ``ids`` are the token ids, ``n_tokens`` their number, ``round_trip`` says whether
    decoding gives the text again (a text with U+2581 does not), ``parity`` whether SentencePiece
    itself gives the same ids.  A null or empty text has no ids.  Each row stands alone, so repeated
    rows get equal results; no rows give no rows.  Columns not carried are ignored,
    one named like a result is left out.  A task encodes its batches with ``threads`` threads, by default
    as many as ``spark.task.cpus`` gives it.
    """
    if threads is None:
        threads = int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))
    carry, ddl = carried(docs, carry, {"n_tokens", "ids", "round_trip", "parity", "_text"})
    taken = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("_text")
    )
    return taken.mapInArrow(
        partial(_encode, data=read_model(model_file), threads=threads, carry=carry),
        ddl + "n_tokens long, ids array<int>, round_trip boolean, parity boolean",
    )


def decode(tokens: DataFrame, carry: list[str], model_file: str = MODEL_FILE) -> DataFrame:
    """The columns ``carry`` and ``text``, from the column ``ids``; null ids give an empty text."""
    carry, ddl = carried(tokens, carry, {"text", "_ids"})
    taken = tokens.select(*[F.col(f"`{c}`") for c in carry], F.col("ids").alias("_ids"))
    return taken.mapInArrow(
        partial(_decode, data=read_model(model_file), carry=carry), ddl + "text string"
    )
