"""Token counts, token alignment and the hash tree against plain Python."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stationlake.llm import manifest, perfect_hash, token_alignment, token_counts
from stationlake.llm.pieces import BPE, MODEL_FILE, NORMAL, PieceModel, read_model
from stationlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"

ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "▁x a▁b"),
    (5, "<s> <0x41> <|endoftext|> </s>a<unk>"),
    (6, "日本語 😀 é\x00\x01 ไทย नमस्ते"),
    (7, "a  b\n\n c\t"),
    (7, "a  b\n\n c\t"),
    (None, "hello world"),
    (8, "etaoin" * 20_000),
    (9, " ".join(["supercalifragilistic words, and more"] * 12_000)),
    (10, "é​" * 50),
]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)


# --- token counts ---


def counted(model, rows):
    sizes = [(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in rows]
    return ordered((d, b, n, n > 4096) for d, b, n in sizes)


def test_counts_equal_the_library_on_the_whole_table(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert ordered(got.collect()) == counted(model, rows)


def test_counts_of_odd_texts(spark, model):
    got = token_counts.count_tokens(spark.createDataFrame(ODD, DOCS), ["doc_id"])
    assert ordered(got.collect()) == counted(model, ODD)


def test_counts_carry_columns_and_drop_clashes(spark):
    df = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_tokens int")
    out = token_counts.count_tokens(df, ["doc_id", "n_tokens"])
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.count_tokens(df.limit(0), ["doc_id"]).collect() == []
    assert token_counts.count_tokens(df, [], limit=1).first()["over_limit"]


def test_random_texts_in_small_windows(model):
    rnd = random.Random(3)
    letters = "abcdeth inrs▁\n\t01.,éüЖжद中文😀\x00<s>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 150))) for _ in range(2000)]
    texts += ["".join(rnd.choice("aeinrst") for _ in range(200)) for _ in range(500)]
    wanted = [len(x) for x in model.encode(texts)]
    for window in (40, 500_000):
        assert token_counts.Counter(read_model(MODEL_FILE), window).count(texts).tolist() == wanted


def test_texts_without_cuts_take_time_in_proportion():
    counter = token_counts.Counter(read_model(MODEL_FILE))
    times = []
    for n in (20_000, 80_000):
        begin = time.perf_counter()
        counter.count(["etaoin" * n])
        times.append(time.perf_counter() - begin)
    assert times[1] < 12 * times[0] + 0.5


def one_at_a_time(scores, text):
    """Merges by rank, then from the left; one merge at once."""
    symbols = list(text)
    while True:
        pairs = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not pairs:
            return len(symbols)
        i = min(pairs)[1]
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]


def test_ranks_that_fall_while_merging():
    # pieces whose parts rank behind them, and equal scores
    rnd = random.Random(8)
    for _ in range(150):
        names = {"a", "b", "c", "▁"} | {
            "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))) for _ in range(14)
        }
        scores = {p: float(-rnd.randint(0, 8)) for p in sorted(names)}
        table = token_counts.merge_table(
            PieceModel([(p, s, NORMAL) for p, s in scores.items()], BPE, byte_fallback=True)
        )
        texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) for _ in range(20)]
        symbols = np.concatenate([table.symbol_of[[ord(c) for c in t]] for t in texts])
        got = token_counts.surviving(table, symbols, np.array([len(t) for t in texts]))
        assert got.tolist() == [one_at_a_time(scores, t) for t in texts]


def test_models_that_are_not_supported():
    for bad in (PieceModel([("a", 0.0, NORMAL)]), PieceModel([("a", 0.0, 4)], BPE, byte_fallback=True)):
        with pytest.raises(ValueError):
            token_counts.merge_table(bad)


# --- perfect hash ---


@pytest.mark.parametrize("n", [0, 1, 2, 300, 50_000])
def test_hash_is_minimal_and_verified(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 45, n))
    shard = perfect_hash.shard_of(keys)
    lookup = perfect_hash.Lookup.of(
        (s, perfect_hash.build_levels(keys[shard == s])) for s in np.unique(shard)
    )
    at = lookup.index(keys)
    assert sorted(at.tolist()) == list(range(n)) and lookup.size == n
    stored = np.zeros(n, np.int64)
    stored[at] = keys
    assert (lookup.verified(keys, stored) == at).all()
    assert (lookup.verified(keys + (1 << 46), stored) == -1).all()


# --- alignment ---


def spans(pieces):
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def aligned(model, rows):
    """Every row's result, token by token."""
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(token_alignment.BYTE_FILE)
    first.encode_special_tokens = True
    alphabet = token_alignment.byte_alphabet()
    total, found = collections.Counter(), []
    for doc, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            cut_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
            cut_b = [
                bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                for i, p in zip(b, map(model.id_to_piece, b))
            ]
            if {b"".join(cut_a), b"".join(cut_b)} != {(" " + text).encode()}:
                a, b = [], []
        if a:
            at_a, at_b = spans(cut_a), spans(cut_b)
            j = 0
            for (begin, end), i in zip(at_a, a):
                while at_b[j][1] <= begin:
                    j += 1
                k = j
                while k < len(b) and at_b[k][0] < end:
                    links.append((i, b[k]))
                    k += 1
            for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
                n, m = (sum(len(g[s]) for g in groups) for s in (0, 1))
                groups.append(
                    (
                        a[n : next(i for i in range(n, len(a)) if at_a[i][1] == end) + 1],
                        b[m : next(i for i in range(m, len(b)) if at_b[i][1] == end) + 1],
                    )
                )
        total.update(links)
        found.append((doc, a, b, groups, links))
    best = collections.Counter()
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    out = []
    for doc, a, b, groups, links in found:
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append(
            (
                doc,
                len(a),
                len(b),
                len(groups),
                len(links),
                sum(total[x] == best[x[1]] for x in links),
                sum(total[x] for x in links),
                hashlib.sha256(shown.encode()).hexdigest() if shown else "",
            )
        )
    return ordered(out)


def short(rows):
    return [(d, t if t is None else t[:2000]) for d, t in rows]


def test_alignment_query_equals_plain_python(spark, model):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    wanted = aligned(model, rows)
    got = QUERIES["op11_token_alignment"](spark, SF)
    assert got.columns == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
    ]
    assert ordered(got.collect()) == wanted


@pytest.mark.parametrize("settings", [{}, {"table_pairs": 1}, {"task_pairs": 3}])
def test_alignment_of_odd_texts(spark, model, settings):
    rows = short(ODD)
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", n_a int")
    out = token_alignment.align(df, ["doc_id", "n_a"], **settings)
    assert out.columns[:2] == ["doc_id", "n_a"] and len(out.columns) == 8
    assert ordered(out.collect()) == aligned(model, rows)
    assert token_alignment.align(df.limit(0), ["doc_id"], **settings).collect() == []


def test_long_texts_are_cut_where_both_tokenizers_cut():
    pair = token_alignment.tokenizers(read_model(token_alignment.BYTE_FILE), read_model(MODEL_FILE))
    text = "some words, it's 12 of them  and\n more " * 40
    parts = token_alignment.parts_of(text, 50)
    assert len(parts) > 10 and " ".join(parts) == text
    for tokenizer in pair:
        assert sum(tokenizer.encode(parts), []) == tokenizer.encode([text])[0]


def text_batch(texts):
    columns = [pa.array(range(len(texts))), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "_text"])


def test_repeated_words_are_tokenized_once(monkeypatch):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(3, 9))) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, k=400)) + "." for _ in range(200)]
    seen = collections.Counter()
    for kind in (token_alignment.ByteTokenizer, token_alignment.ModelTokenizer):

        def counting(self, rows, encode=kind.encode, name=kind.__name__):
            seen[name] += sum(map(len, rows))
            return encode(self, rows)

        monkeypatch.setattr(kind, "encode", counting)
    files = read_model(token_alignment.BYTE_FILE), read_model(MODEL_FILE)
    out = list(token_alignment._align([text_batch(texts)], files, ["doc_id"]))
    assert sum(b.num_rows for b in out) == 200
    assert all(0 < n < 0.05 * sum(map(len, texts)) for n in seen.values()) and len(seen) == 2


@pytest.mark.parametrize("settings", [{}, {"table_pairs": 1}])
def test_alignment_of_random_texts(spark, model, settings):
    rnd = random.Random(11)
    parts = ["a", "th", "e", "Hello", "12", ".", "'s", "'", " ", " ", " ", " ", "  ", "\n", "\t", "\r"]
    parts += ["é", "e\u0301", "\u0301", "\u4e2d\u6587", "\U0001f600", "\xa0", "\u3000", "\x85", "\x1c", "<s>", "\u200b"]
    rows = [(i, "".join(rnd.choices(parts, k=rnd.randint(0, 25)))) for i in range(600)]
    # the mark makes bytes differ: such texts have no tokens, their neighbours keep theirs
    rows += [(1000 + i, f"some words and{mark} more of them") for i, mark in enumerate(["", "\u2581", "", " \u2581"])]
    out = token_alignment.align(spark.createDataFrame(rows, DOCS).coalesce(1), ["doc_id"], **settings)
    assert ordered(out.collect()) == aligned(model, rows)


def test_cuts_lie_before_single_spaces_between_visible_characters():
    texts = ["a b  c", " x", "1 \u00e9 2 3\n 4", "d"]
    chunks, first = token_alignment.chunks_of(pa.array(texts))
    whole = [" a", " b  c", "  x", " 1 \u00e9 2", " 3\n 4", " d"]
    assert [c.decode() for c in chunks.to_pylist()] == whole and first.tolist() == [0, 2, 3, 5, 6]
    chunks, first = token_alignment.chunks_of(pa.array(texts), whole=True)
    assert [c.decode() for c in chunks.to_pylist()] == [" " + t for t in texts] and first.tolist() == [0, 1, 2, 3, 4]


def test_texts_with_changed_bytes_are_told_apart():
    files = read_model(token_alignment.BYTE_FILE), read_model(MODEL_FILE)
    texts = pa.array(["some words here", "some \u2581 words", "more here"])
    assert token_alignment.AlignedTexts(texts, files).changed.tolist() == [False, True, False]
    whole = token_alignment.AlignedTexts(texts, files, whole=True)
    assert (whole.numbers[0] > 0).tolist() == [True, False, True] and whole.digests()[1] == ""


# --- hash tree ---


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return out


def proven(rows):
    """Rows of doc_id, source, lang, n_chars, text."""
    leaf = lambda r: digest("".join(map(value, r)))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {
        s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        for s in sources
    }
    trees = {s: levels_of([leaf(r) for r in members[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(members[s]):
            path, node = way(trees[s], i) + way(top, k), leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                node = digest(left + node + right)
            proof = digest("".join(a + b for a, b in path))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return ordered(out)


TREE = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_of_odd_rows(spark, depth):
    rnd = random.Random(depth)
    pick = rnd.choice
    rows = [
        (
            pick([None, *range(40), -3, 10**12]),
            pick([None, "", "a", "a", "a", "b", "é", "𐍈", "Z"]),
            pick([None, "en"]),
            pick([None, 3]),
            pick([None, "", "a\nb", "x", "\n"]),
        )
        for _ in range(120)
    ]
    rows += rows[:5] + [(77, "a", None, None, "long\n" * 50_000)]
    df = spark.createDataFrame(rows, TREE).selectExpr("*", "1 AS leaf", "2 AS series_pos")
    out = manifest.manifest(df, depth)
    assert out.columns == [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    ]
    assert ordered(out.collect()) == proven(rows)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(3, None, None, None, "a\nb")]
    got = manifest.manifest(spark.createDataFrame(rows, TREE)).first()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == digest("")
    assert manifest.manifest(spark.createDataFrame([], TREE)).collect() == []


def test_parents_resume_from_their_copies():
    nodes = [digest(str(i)) for i in range(8)]
    tree = manifest.grow(nodes, None)
    for at in range(8):
        node = digest("other")
        changed = nodes[:at] + [node] + nodes[at + 1 :]
        for level, (_, right) in enumerate(tree.path(at)):
            node = manifest.resume(tree.states[level][at // 3**level], node, right)
        assert node == manifest.grow(changed, None).top
        assert tree.top == manifest.grow(nodes, None).top
