"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the token pairs that meet.

Both tokenizers cut the same bytes; where both end a token a group ends, and tokens whose bytes
overlap are linked.  Texts are cut at single spaces, where both tokenizers cut too, and each distinct
chunk of some megabytes of text is tokenized and aligned once.  The first pass writes the links of
each document, the second counts linked pairs per task.  The distinct pairs get a minimal perfect
hash, counts become dense vectors indexed by it, and a tree of sums makes one vector of each shard.
The third pass looks the pairs of the documents up, keys verified.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import cached_property, lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import carried, slices
from stationlake.llm.perfect_hash import Lookup, build_levels, shard_of
from stationlake.llm.pieces import BYTE, CONTROL, MODEL_FILE, SPACE, parse_model, read_model
from stationlake.session import materialise

BYTE_FILE = "/opt/tokenizers/byte_bpe_50k.json"

#: Pairs that the broadcast table may hold, about 20 bytes each; more are joined instead.
TABLE_PAIRS = 2_000_000

#: Pairs a task gathers before it hands them on, and entries of a group of counts.
TASK_PAIRS = 250_000

#: Vectors that one node of the tree adds up.
TREE_FAN = 16

#: Text tokenized at once, in bytes.
TOKENIZED_BYTES = 200_000

#: Fixed value: what byte-level tokenizers split a text by before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A pair is the id of the first tokenizer times this plus that of the second.
_SHIFT = 1 << 31

#: What is known of a document without the others.
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")

_LONG_SPACE = re.compile(r"\s{2000}")

#: Chunks tokenized in one row, in bytes; the second tokenizer takes more time a byte for longer rows.
ROW_BYTES = 2_000

#: Text whose distinct chunks are looked for at once, in bytes.
CHUNKED_BYTES = 4_000_000

#: Links counted or looked up at once.
LINKS_AT_ONCE = 1_000_000

_SAFE_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes.

    Printable bytes of Latin-1 stand for themselves, the others for characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """A byte-level BPE file, run by ranks; ``bytes`` are those of each id.

    Its merges make the ids that follow the 256 bytes one after another, so ids are ranks, and
    merging the lowest rank first gives the file's own tokens.  The pattern of the backend fails on very
    long white space; texts with that are left to the slower library that wrote the file.
    """

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        before, model = spec["pre_tokenizer"], spec["model"]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if before["type"] != "ByteLevel" or not before["use_regex"] or spec["normalizer"]:
            raise ValueError("only byte-level tokenizers with the usual pattern")
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("only tokenizers whose ids follow their merges")
        alphabet = byte_alphabet()
        plain = [*alphabet, *merged]
        ranks = {bytes(map(alphabet.__getitem__, t)): model["vocab"][t] for t in plain}
        self.backend = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = sorted(ranks, key=ranks.__getitem__)
        self.tokens = pa.array(self.bytes, pa.large_binary())
        self.data = data

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        out = Tokenizer.from_str(self.data.decode())
        out.encode_special_tokens = True
        out.no_padding()
        out.no_truncation()
        return out

    def encode_one(self, text: str) -> list[int]:
        if _LONG_SPACE.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.backend.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_one(" " + x) for x in texts]


class ModelTokenizer:
    """A SentencePiece model that puts a space before each text."""

    def __init__(self, data: bytes):
        import sentencepiece

        model = parse_model(data)
        if not model.dummy_prefix or any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in model.pieces):
            raise ValueError("only models that add a space and whose pieces don't reach over one")
        self.backend = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [
            bytes([int(p[3:5], 16)])
            if kind == BYTE
            else b""
            if kind == CONTROL
            else p.replace(SPACE, " ").encode()
            for p, _, kind in model.pieces
        ]
        self.tokens = pa.array(self.bytes, pa.large_binary())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.backend.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizers(byte_data: bytes, model_data: bytes) -> tuple[ByteTokenizer, ModelTokenizer]:
    return ByteTokenizer(byte_data), ModelTokenizer(model_data)


@lru_cache(maxsize=4)
def token_lengths(byte_data: bytes, model_data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(b) for b in t.bytes]) for t in tokenizers(byte_data, model_data))


def parts_of(text: str, most: int = TOKENIZED_BYTES) -> list[str]:
    """A text without the single spaces between letters at which it is cut for being long.

    Either tokenizer puts a space before a part, and starts a token there in the whole text too.
    """
    out, at = [], 0
    while len(text) - at > most and (cut := _SAFE_CUT.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def tokens_of(pair, texts: list[str | None]) -> list[list[list[int]]]:
    """Ids of all texts by both tokenizers; none where the bytes of either aren't those of the text."""
    parts = [parts_of(text) if text else [] for text in texts]
    flat = [part for of_text in parts for part in of_text]
    ends = np.cumsum([len(x) for x in parts]).tolist()
    out = []
    for tokenizer in pair:
        ids = tokenizer.encode(flat) if flat else []
        found = [ids[a] if b == a + 1 else sum(ids[a:b], []) for a, b in zip([0, *ends], ends)]
        for i, text in enumerate(texts):
            whole = b" " + text.encode("utf-8", "surrogatepass") if text else b""
            if b"".join(map(tokenizer.bytes.__getitem__, found[i])) != whole:
                found[i] = None
        out.append(found)
    return [[ids if ids is not None and other is not None else [] for ids, other in zip(x, y)] for x, y in (out, out[::-1])]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array without nulls and where each entry begins, followed by their end."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    begin = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[begin[0] : begin[-1]], begin - begin[0]


def _plain(data: np.ndarray) -> np.ndarray:
    """Which bytes are visible ASCII characters."""
    return (data > 0x20) & (data < 0x7F)


def chunks_of(texts: pa.Array, whole: bool = False) -> tuple[pa.BinaryArray, np.ndarray]:
    """All texts, none null or empty, with a space before each, cut before spaces that both tokenizers cut at.

    Those are single ones between visible ASCII characters: the pattern of the first begins a new
    part there, pieces of the second don't reach over one.  The second result is the first chunk of each text,
    and the number of all.  ``whole`` texts are not cut.
    """
    data, begin = _bytes_of(pc.binary_join_element_wise(" ", texts, ""))
    cut = np.zeros(len(data), bool)
    if not whole:
        plain = _plain(data)
        cut[1:-1] = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
    cut[begin[:-1]] = True
    at = np.r_[np.flatnonzero(cut), len(data)]
    buffers = [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, buffers), np.searchsorted(at, begin)


def _joined_tokens(pair, lengths, chunks: pa.BinaryArray) -> list[pa.ListArray] | None:
    """Ids of each chunk by both tokenizers, run on all chunks in a row; none if bytes or cuts differ."""
    data, begin = _bytes_of(chunks)
    blob = data.tobytes()
    bounds = begin[np.r_[0, np.flatnonzero(np.diff(begin[:-1] // ROW_BYTES)) + 1, len(chunks)]].tolist()
    texts = [blob[a + 1 : b].decode() for a, b in zip(bounds, bounds[1:])]
    out = []
    for tokenizer, n in zip(pair, lengths):
        ids = np.fromiter(chain.from_iterable(tokenizer.encode(texts)), np.int32)
        if not np.array_equal(_bytes_of(tokenizer.tokens.take(pa.array(ids)))[0], data):
            return None
        ends = np.cumsum(n[ids])
        last = np.searchsorted(ends, begin[1:])
        if (ends[last] != begin[1:]).any():
            return None
        out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, last + 1], pa.int32()), pa.array(ids)))
    return out


def _own_tokens(pair, chunks: pa.BinaryArray) -> list[pa.ListArray]:
    found = tokens_of(pair, [c[1:].decode() for c in chunks.to_pylist()])
    return [pa.array(ids, pa.list_(pa.int32())) for ids in found]


def _parts(members: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Members in parts of about `TOKENIZED_BYTES`, one at least."""
    return np.split(members, np.flatnonzero(np.diff(np.cumsum(size[members]) // TOKENIZED_BYTES)) + 1)


class Aligned:
    """Groups and links of some texts, all in arrays one behind another; ``columns`` are lists of ids."""

    def __init__(self, columns: list[pa.ListArray], files: tuple[bytes, bytes]):
        self.docs = len(columns[0])
        # slices of list arrays keep the values of the whole
        self.ids = [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        counts = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in columns]
        self.counts = [c.astype(np.int64) for c in counts]
        self.ends = [np.cumsum(n[i]) for n, i in zip(token_lengths(*files), self.ids)]
        owners = [np.repeat(np.arange(self.docs), c) for c in self.counts]
        # where both end a token; a token of no bytes does not occur
        near = np.searchsorted(self.ends[0], self.ends[1])
        both = self.ends[0][near] == self.ends[1]
        self.cuts, at = self.ends[1][both], near[both]
        self.groups = np.bincount(owners[0][at], minlength=self.docs)
        # each stretch between two ends, of either tokenizer, is one linked pair
        stops = np.sort(np.concatenate([self.ends[0], self.ends[1][~both]]))
        left, right = (np.searchsorted(e, stops) for e in self.ends)
        self.links = self.ids[0][left] * _SHIFT + self.ids[1][right]
        self.n_links = np.bincount(owners[0][left], minlength=self.docs)

    def shown(self, names: pa.LargeStringArray) -> pa.LargeStringArray:
        """The groups of each text, ``a1,a2|b1;a3|b2;``, written by `_names`."""
        group = [np.searchsorted(self.cuts, e) for e in self.ends]
        sizes = [np.bincount(g, minlength=len(self.cuts)) for g in group]
        before = [np.cumsum(s) - s for s in sizes]
        out = np.empty(sum(len(i) for i in self.ids), np.int64)
        places = [
            np.arange(len(group[0])) + before[1][group[0]],
            np.arange(len(group[1])) + (before[0] + sizes[0])[group[1]],
        ]
        for side in (0, 1):
            last = np.r_[group[side][1:] != group[side][:-1], True][: len(group[side])]
            out[places[side]] = 4 * self.ids[side] + 2 * side + last
        data, begin = _bytes_of(names.take(pa.array(out)))
        ends = np.cumsum(self.counts[0] + self.counts[1])
        buffers = [None, pa.py_buffer(begin[np.r_[0, ends]]), pa.py_buffer(data)]
        return pa.Array.from_buffers(pa.large_string(), self.docs, buffers)


@lru_cache(maxsize=4)
def _names(size: int) -> pa.LargeStringArray:
    """Decimal ids of both tokenizers, followed by what stands within and at the end of their part."""
    return pa.array([f"{i}{mark}" for i in range(size) for mark in ",|,;"], pa.large_string())


def _totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values from each bound to the next."""
    return np.diff(np.r_[0, np.cumsum(values.astype(np.int64))][bounds])


class AlignedTexts:
    """Numbers, written groups and packed links of texts, from those of their distinct chunks."""

    def __init__(self, texts: pa.Array, files: tuple[bytes, bytes], whole: bool = False):
        pair, lengths = tokenizers(*files), token_lengths(*files)
        base, kind = packing(*map(len, lengths))
        names = _names(max(map(len, lengths)))
        chunks, self.first = chunks_of(texts, whole)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary
        data, begin = _bytes_of(distinct)
        # those that may stand in a row: cuts between them are like cuts of a text
        plain = _plain(data)
        free = plain[begin[:-1] + 1] & plain[begin[1:] - 1] & (not whole)
        runs = [(p, run) for run in (True, False) for p in _parts(np.flatnonzero(free == run), np.diff(begin)) if len(p)]
        found, shown = [], []
        for members, run in runs:
            part = distinct.take(pa.array(members))
            ids = run and _joined_tokens(pair, lengths, part) or _own_tokens(pair, part)
            one = Aligned(ids, files)
            links = (one.links // _SHIFT * base + one.links % _SHIFT).astype(kind)
            found.append([*one.counts, one.groups, one.n_links, links])
            shown.append(one.shown(names))
        *numbers, self.links = (np.concatenate(x) for x in zip(*found))
        place = np.empty(len(distinct), np.int64)
        place[np.concatenate([members for members, _ in runs])] = np.arange(len(distinct))
        self.at = place[coded.indices.to_numpy()]
        self.numbers = [_totals(x[self.at], self.first) for x in numbers]
        #: Texts with a chunk that has no tokens, its bytes being changed.
        self.changed = _totals(numbers[0][self.at] == 0, self.first) > 0
        self.n_links = numbers[3]
        self.shown = pa.concat_arrays(shown)

    def digests(self) -> list[str]:
        data, begin = _bytes_of(self.shown.take(pa.array(self.at)))
        bounds = begin[self.first].tolist()
        spans = zip(bounds, bounds[1:])
        return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in spans]

    def packed_links(self) -> pa.BinaryArray:
        n = self.n_links[self.at]
        shift = (np.cumsum(self.n_links) - self.n_links)[self.at] - (np.cumsum(n) - n)
        links = self.links[np.arange(n.sum()) + np.repeat(shift, n)]
        ends = np.cumsum(self.numbers[3]) * links.itemsize
        buffers = [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(links)]
        return pa.Array.from_buffers(pa.binary(), len(ends), buffers)


def packing(first: int, second: int) -> tuple[int, type]:
    """Links are written as the first id times this plus the second, in numbers of this type."""
    return second, np.uint32 if first * second < 1 << 32 else np.uint64


def _unpacked(links: np.ndarray, base: int) -> np.ndarray:
    return links.astype(np.int64) // base * _SHIFT + links.astype(np.int64) % base


def _rows(batch: pa.RecordBatch, texts: AlignedTexts | None, carry: list[str]) -> pa.RecordBatch:
    """Numbers, digest and links of the rows of a batch; without ``texts`` they have none."""
    empty = np.zeros(batch.num_rows, np.int64)
    numbers = texts.numbers if texts else [empty] * 4
    digests = texts.digests() if texts else [""] * batch.num_rows
    links = texts.packed_links() if texts else [b""] * batch.num_rows
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c) for c in carry],
            *[pa.array(x, pa.int64()) for x in numbers],
            pa.array(digests, pa.string()),
            pa.array(links, pa.binary()),
        ],
        [*carry, *NUMBERS, "groups_sha256", "_links"],
    )


def _align(batches, files: tuple[bytes, bytes], carry: list[str]):
    for big in batches:
        for batch in slices(big, "_text", CHUNKED_BYTES):
            text = batch.column("_text")
            empty = pc.equal(pc.fill_null(pc.binary_length(text), 0), 0)
            # the second tokenizer changes the mark, wherever it stands
            marked = pc.fill_null(pc.match_substring(text, SPACE), False)
            if (rest := batch.filter(empty)).num_rows:
                yield _rows(rest, None, carry)
            if (rest := batch.filter(marked)).num_rows:
                yield _rows(rest, AlignedTexts(rest.column("_text"), files, whole=True), carry)
            if (rest := batch.filter(pc.invert(pc.or_(empty, marked)))).num_rows:
                texts = AlignedTexts(rest.column("_text"), files)
                changed = pa.array(texts.changed)
                yield _rows(rest, texts, carry).filter(pc.invert(changed))
                # whether the bytes are changed is a matter of the whole text
                if (rest := rest.filter(changed)).num_rows:
                    yield _rows(rest, AlignedTexts(rest.column("_text"), files, whole=True), carry)


def _links_of(batches, kind: type):
    """Parts of the batches, their links one behind another and where those of each row begin."""
    width = np.dtype(kind).itemsize
    for batch in batches:
        size = pc.binary_length(batch.column("_links")).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // (width * LINKS_AT_ONCE))) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                part = batch.slice(a, b - a)
                data, begin = _bytes_of(part.column("_links"))
                yield part, data.view(kind), begin // width


def _by_shard(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    shard = shard_of(keys)
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    offsets = pa.array(np.r_[first, len(keys)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int64())) for x in (keys, n)]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *lists], ["shard", "keys", "n"])


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate(n))
    return distinct, total


def _count_pairs(batches, base: int, kind: type, most: int):
    """Pairs of a task and how many links hold them, by shard, in portions of about ``most``."""
    keys, n, size = [], [], 0
    for _, links, _ in _links_of(batches, kind):
        distinct, count = np.unique(links, return_counts=True)
        keys.append(_unpacked(distinct, base))
        n.append(count)
        size += len(distinct)
        if size > 2 * most:
            keys, n = ([x] for x in _summed(keys, n))
            size = len(keys[0])
            if size > most:
                yield _by_shard(keys[0], n[0])
                keys, n, size = [], [], 0
    if size:
        yield _by_shard(*_summed(keys, n))


def _hash_shards(batches):
    """Per shard the levels of its hash and its keys by index."""
    for batch in batches:
        for i in range(batch.num_rows):
            keys = batch.column("keys")[i].values.to_numpy(zero_copy_only=False)
            shard = batch.column("shard")[i].as_py()
            levels = build_levels(keys)
            stored = np.empty_like(keys)
            stored[Lookup.of([(shard, levels)]).index(keys)] = keys
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
                    pa.array([stored], pa.list_(pa.int64())),
                ],
                ["shard", "levels", "stored"],
            )


def _levels(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in raw]


def _row(shard: int, node: int, counts: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "shard": pa.array([shard], pa.int32()),
            "node": pa.array([node], pa.int64()),
            "counts": pa.array([counts], pa.list_(pa.int64())),
        }
    )


def _dense(counted: pa.Table, hashed: pa.Table) -> pa.Table:
    """The counts of some portions as a vector indexed by the hash of the shard."""
    shard, node = hashed["shard"][0].as_py(), hashed["node"][0].as_py()
    stored = hashed["stored"][0].values.to_numpy(zero_copy_only=False)
    lookup = Lookup.of([(shard, _levels(hashed["levels"][0].as_py()))])
    vector = np.zeros(len(stored), np.int64)
    for keys, n in zip(counted["keys"], counted["n"]):
        at = lookup.verified(keys.values.to_numpy(zero_copy_only=False), stored)
        if (at < 0).any():
            raise ValueError("a pair that was counted is missing from the hash")
        vector[at] += n.values.to_numpy(zero_copy_only=False)  # keys of a portion are distinct
    return _row(shard, node, vector)


def _add(vectors: pa.Table) -> pa.Table:
    total = sum(x.values.to_numpy(zero_copy_only=False) for x in vectors["counts"])
    return _row(vectors["shard"][0].as_py(), vectors["parent"][0].as_py(), total)


def _highest(batches):
    """Of each id of the second tokenizer the highest count in a shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            b = batch.column("stored")[i].values.to_numpy(zero_copy_only=False) % _SHIFT
            n = batch.column("counts")[i].values.to_numpy(zero_copy_only=False)
            most = np.zeros(b.max() + 1, np.int64)
            np.maximum.at(most, b, n)
            ids = np.unique(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most[ids])], ["b", "n"])


def pair_counts(links: DataFrame, base: int, kind: type, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """One row per shard of the pairs: levels of its hash, keys and counts by index."""
    counted = materialise(
        links.select("_links").mapInArrow(
            partial(_count_pairs, base=base, kind=kind, most=task_pairs),
            "shard int, keys array<long>, n array<long>",
        ),
        "pairs",
    )
    distinct = counted.select("shard", F.explode("keys").alias("key")).distinct()
    # a shard has at most a 256th of the product of the vocabularies
    hashed = materialise(
        distinct.groupBy("shard").agg(F.collect_list("key").alias("keys")).mapInArrow(
            _hash_shards, "shard int, levels array<binary>, stored array<long>"
        ),
        "hashes",
    )
    largest = counted.groupBy("shard").agg(F.sum(F.size("keys")).alias("n")).agg(F.max("n")).first()[0]
    fan = max(1, -(-(largest or 0) // task_pairs))
    nodes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(fan - 1).cast("bigint")))
    vectors = (
        counted.withColumn("node", F.pmod(F.xxhash64("keys"), F.lit(fan)))
        .groupBy("shard", "node")
        .cogroup(hashed.select("*", nodes.alias("node")).groupBy("shard", "node"))
        .applyInArrow(_dense, "shard int, node long, counts array<long>")
    )
    while fan > 1:
        fan = -(-fan // TREE_FAN)
        vectors = (
            vectors.withColumn("parent", F.pmod("node", F.lit(fan)))
            .groupBy("shard", "parent")
            .applyInArrow(_add, "shard int, node long, counts array<long>")
        )
    return materialise(hashed.join(vectors.select("shard", "counts"), "shard"), "counts")


def _look_up(batches, base: int, kind: type, carry: list[str], table):
    lookup, stored, counts, best = table.value
    for batch, links, begin in _links_of(batches, kind):
        distinct, which = np.unique(links, return_inverse=True)
        keys = _unpacked(distinct, base)
        at = lookup.verified(keys, stored)
        if (at < 0).any():
            raise ValueError("a pair of a document is missing from the table")
        n = counts[at]
        highest = n == best[keys % _SHIFT]
        sums = [pa.array(_totals(x[which], begin), pa.int64()) for x in (highest, n)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in (*carry, *NUMBERS)], *sums, batch.column("groups_sha256")],
            [*carry, *NUMBERS, "n_best", "count_sum", "groups_sha256"],
        )


def _spread(batches, base: int, kind: type, carry: list[str]):
    """Instead of sums, the distinct pairs of each document."""
    kept = [*carry, *NUMBERS, "groups_sha256"]
    for batch, links, begin in _links_of(batches, kind):
        found = [np.unique(links[a:b], return_counts=True) for a, b in zip(begin, begin[1:])]
        lists = [[_unpacked(k, base) for k, _ in found], [n for _, n in found]]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in kept], *[pa.array(x, pa.list_(pa.int64())) for x in lists]],
            [*kept, "_keys", "_times"],
        )


def _broadcast_table(counts: DataFrame, best: np.ndarray):
    """The whole table for the tasks; its size has been checked."""
    rows = counts.select("shard", "levels", "stored", "counts").toArrow().sort_by("shard")
    lookup = Lookup.of(zip(rows["shard"].to_pylist(), map(_levels, rows["levels"].to_pylist())))
    flat = [
        rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for c in ("stored", "counts")
    ]
    return counts.sparkSession.sparkContext.broadcast((lookup, *flat, best))


def _joined(spread: DataFrame, counts: DataFrame, highest: DataFrame, names: list[str]) -> DataFrame:
    """Sums per document by a join of its pairs with the table, which may be of any size."""
    spread = materialise(spread.withColumn("_doc", F.monotonically_increasing_id()), "spread")
    table = counts.select(F.explode(F.arrays_zip("stored", "counts")).alias("x")).select(
        F.col("x.stored").alias("_key"), F.col("x.counts").alias("_n")
    )
    table = table.join(
        highest.select(F.col("b").alias("_b"), F.col("n").alias("_most")),
        F.col("_key") % _SHIFT == F.col("_b"),
    )
    met = spread.select("_doc", F.explode(F.arrays_zip("_keys", "_times")).alias("x")).select(
        "_doc", F.col("x._keys").alias("_key"), F.col("x._times").alias("_times")
    )
    sums = met.join(table, "_key").groupBy("_doc").agg(
        F.sum(F.when(F.col("_n") == F.col("_most"), F.col("_times"))).alias("_highest"),
        F.sum(F.col("_n") * F.col("_times")).alias("_sum"),
    )
    return spread.join(sums, "_doc", "left").select(
        *[F.col(f"`{c}`") for c in names],
        *NUMBERS,
        F.coalesce("_highest", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )


def align(
    docs: DataFrame,
    carry: list[str],
    byte_file: str = BYTE_FILE,
    model_file: str = MODEL_FILE,
    table_pairs: int = TABLE_PAIRS,
    task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` and how the two tokenizers cut every whole text.

    ``n_a`` and ``n_b`` are tokens, ``n_groups`` the groups between common ends, ``n_links`` the
    overlapping pairs of tokens; ``count_sum`` adds up how many links of all documents hold the
    pair of ids of each link, ``n_best`` counts links whose number is the highest of
    their second id, ties included; ``groups_sha256`` hashes the ids by group.  Null and empty
    texts, and those whose bytes a tokenizer changes (the mark U+2581 becomes a space), have no tokens:
    zeros and an empty string.  Repeated rows each count.  No rows give no rows.  Columns not
    carried are ignored, one named like a result is left out.

    Up to ``table_pairs`` distinct pairs are broadcast; beyond, pairs of documents are joined with them.
    """
    results = {*NUMBERS, "n_best", "count_sum", "groups_sha256"}
    inner = {"_text", "_links", "_doc", "_keys", "_times", "_highest", "_sum"}
    carry, ddl = carried(docs, carry, results | inner)
    files = (read_model(byte_file), read_model(model_file))
    sizes = [len(x) for x in token_lengths(*files)]
    base, kind = packing(*sizes)
    texts = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("_text")
    )
    numbers = ddl + "".join(f"{c} long, " for c in NUMBERS)
    links = materialise(
        texts.mapInArrow(
            partial(_align, files=files, carry=carry), numbers + "groups_sha256 string, _links binary"
        ),
        "links",
    )
    counts = pair_counts(links, base, kind, task_pairs)
    # at most one row per id of the vocabulary
    highest = counts.mapInArrow(_highest, "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    pairs = counts.agg(F.sum(F.size("stored"))).first()[0] or 0
    if pairs > table_pairs:
        ddl = numbers + "groups_sha256 string, _keys array<long>, _times array<long>"
        spread = links.mapInArrow(partial(_spread, base=base, kind=kind, carry=carry), ddl)
        return _joined(spread, counts, highest, carry)
    best = np.zeros(sizes[1], np.int64)
    for row in highest.collect():
        best[row["b"]] = row["n"]
    table = _broadcast_table(counts, best)
    return links.mapInArrow(
        partial(_look_up, base=base, kind=kind, carry=carry, table=table),
        numbers + "n_best long, count_sum long, groups_sha256 string",
    )
