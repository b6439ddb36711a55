"""Language identification: script ranges, word scores and Viterbi over words.

Characters fall into ranges of scripts.  A word can only be in a language whose training
texts use the word's script.  Its score per language is the mean log-likelihood ratio of
its character n-grams.  Viterbi finds the best sequence of languages over the words of
a text, where every change of language costs a penalty; runs of one language are spans.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.llm.common import carried, slices

#: First code points of ranges of scripts and their names; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "common"),
    (0x0041, "latin"),
    (0x005B, "common"),
    (0x0061, "latin"),
    (0x007B, "common"),
    (0x00AA, "latin"),
    (0x02B0, "common"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "asian"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "common"),
    (0x2E80, "han"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0x3130, "hangul"),
    (0x3190, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB50, "arabic"),
    (0xFE00, "common"),
    (0xFE70, "arabic"),
    (0xFF00, "common"),
    (0x20000, "han"),
)
_STARTS = [start for start, _ in SCRIPTS]
NAMES = sorted({name for _, name in SCRIPTS})

UND = "und"


@dataclass(frozen=True)
class Settings:
    """``fit_rows``: labelled documents per language that are fitted on, in expectation; which
    ones is decided by a hash of their id and the counts of all labelled rows.
    ``buckets``: rows of the table of n-grams.  ``switch``: cost of changing the language, in nats.
     ``cap``: largest score of a word for or against a language."""

    fit_rows: int = 2000
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (1, 2, 3, 4)
    switch: float = 8.0
    cap: float = 3.0


@dataclass(frozen=True)
class Model:
    """Languages in order, scores (bucket, language), and the scripts each language uses."""

    languages: tuple[str, ...]
    scores: np.ndarray
    scripts: np.ndarray
    settings: Settings


def script_of(word: str) -> int:
    """The script of most letters of a word, as an index into ``NAMES``; -1 without letters."""
    counts: dict[int, int] = {}
    for c in word:
        if c.isalpha():
            s = bisect_right(_STARTS, ord(c)) - 1
            counts[s] = counts.get(s, 0) + 1
    if not counts:
        return -1
    return NAMES.index(SCRIPTS[max(counts, key=counts.get)][1])


def gram_buckets(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words, marked at both ends, and where each word's begin."""
    marked = [f"\x02{w}\x03" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    for n in settings.grams:
        if len(codes) < n:
            continue
        last = len(codes) - n + 1
        h = np.full(last, n, np.uint64)
        for i in range(n):
            h = (h ^ codes[i : i + last]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = word[:last] == word[n - 1 :]
        found.append((h[inside] % np.uint64(settings.buckets)).astype(np.int64))
        owner.append(word[:last][inside])
    if not found:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    starts = np.searchsorted(owners[order], np.arange(len(words)))
    return np.concatenate(found)[order], starts


def _count(batches, settings: Settings):
    """Per language and bucket the n-grams of a task's texts; per language its scripts."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = [w for w in text.lower().split() if script_of(w) >= 0]
                if not words:
                    continue
                if lang not in grams:
                    grams[lang] = np.zeros(settings.buckets, np.int64)
                    scripts[lang] = np.zeros(len(NAMES), np.int64)
                found, _ = gram_buckets(words, settings)
                grams[lang] += np.bincount(found, minlength=settings.buckets)
                scripts[lang] += np.bincount([script_of(w) for w in words], minlength=len(NAMES))
    for lang, counts in grams.items():
        both = np.concatenate([counts, scripts[lang]])
        used = np.nonzero(both)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used)), pa.array(used), pa.array(both[used])],
            ["lang", "bucket", "n"],
        )


def fit(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on ``docs (doc_id, text, lang)``; rows without text or lang don't count.

    The table brought to the driver has at most ``buckets`` rows per language.
    """
    settings = settings or Settings()
    labelled = docs.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model((), np.zeros((settings.buckets, 0)), np.zeros((len(NAMES), 0), bool), settings)
    languages = tuple(sorted(sizes))
    part = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 11) / float(1 << 53)
    rate = F.create_map(
        *[x for k in languages for x in (F.lit(k), F.lit(settings.fit_rows / sizes[k]))]
    )
    chosen = labelled.where(part < F.element_at(rate, F.col("lang"))).select("lang", "text")
    rows = (
        chosen.mapInArrow(partial(_count, settings=settings), "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    counts = np.zeros((settings.buckets + len(NAMES), len(languages)))
    at = rows["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64)
    counts[rows["bucket"].to_numpy(np.int64), at] = rows["n"].to_numpy(float)
    grams, scripts = counts[: settings.buckets], counts[settings.buckets :]
    smooth = grams + 0.5
    logs = np.log(smooth / smooth.sum(0))
    # against the mean of all languages, so that common n-grams say nothing
    scores = logs - logs.mean(1, keepdims=True)
    # a script counts for a language if at least one word in a hundred uses it
    used = scripts >= 0.01 * np.maximum(1, scripts.sum(0))
    return Model(languages, scores.astype(np.float32), used, settings)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Scores (word, language) of distinct lower-case words; languages of other scripts lose."""
    found, starts = gram_buckets(words, model.settings)
    values = model.scores[found]
    sums = np.add.reduceat(values, starts, axis=0) if len(found) else np.zeros((0, values.shape[1]))
    sizes = np.diff(np.append(starts, len(found)))[:, None]
    # a word of n letters says about as much as n / 2 independent n-grams
    scores = np.clip(sums / sizes * np.sqrt(sizes), -model.settings.cap, model.settings.cap)
    script = np.array([script_of(w) for w in words])
    allowed = np.where((script >= 0)[:, None], model.scripts[script], True)
    none = ~allowed.any(1, keepdims=True)
    scores = np.where(allowed | none, scores, -2 * model.settings.cap)
    scores[script < 0] = 0
    return scores.astype(np.float32)


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word of several texts laid one after another.

    All texts step together, longest first, so each step is one array operation.
    """
    out = np.zeros(len(scores), np.int16)
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    longest = int(lengths[0]) if len(lengths) else 0
    if not longest:
        return out
    # how many texts have more than t words
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")
    best = np.zeros((int(alive[0]), scores.shape[1]), np.float32)
    came = np.empty((len(scores), scores.shape[1]), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(longest):
        n = int(alive[t])
        at = begins[:n] + t
        if t:
            old = best[:n]
            top = old.argmax(1)
            change = old[np.arange(n), top] - switch
            stay = old >= change[:, None]
            came[at] = np.where(stay, own, top[:, None])
            best[:n] = np.where(stay, old, change[:, None])
        best[:n] += scores[at]
    state = np.zeros(len(lengths), np.int64)
    for t in range(longest - 1, -1, -1):
        n = int(alive[t])
        ends = int(alive[t + 1]) if t + 1 < longest else 0
        # texts that end here start from their best state, the others from where they came
        state[ends:n] = best[ends:n].argmax(1)
        at = begins[:n] + t
        if ends:
            later = begins[:ends] + t + 1
            state[:ends] = came[later, state[:ends]]
        out[at] = state[:n]
    return out


def _label(batches, model: Model, carry: list[str]):
    languages = model.languages
    memo: dict[str, int] = {}
    table = np.zeros((0, len(languages)), np.float32)
    letters = np.zeros(0, np.int64)
    for whole in batches:
        for batch in slices(whole, "_text"):
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            split = [x.lower().split() for x in texts]
            if len(memo) * max(1, len(languages)) > 4_000_000:
                memo, table, letters = {}, table[:0], letters[:0]
            new = list(dict.fromkeys(w for ws in split for w in ws if w not in memo))
            if new and languages:
                memo |= {w: len(memo) + i for i, w in enumerate(new)}
                table = np.concatenate([table, word_scores(new, model)])
                count = [sum(map(str.isalpha, w)) for w in new]
                letters = np.concatenate([letters, np.array(count, np.int64)])
            labels, shares, spans = [], [], []
            sizes = np.array([len(ws) for ws in split], np.int64)
            if languages:
                index = np.fromiter((memo[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
                path = viterbi(table[index], sizes, model.settings.switch)
                weight = letters[index]
            end = 0
            for n in sizes:
                begin, end = end, end + int(n)
                if not languages or not weight[begin:end].any():
                    labels.append(UND)
                    shares.append(0.0)
                    spans.append([])
                    continue
                own = path[begin:end]
                per = np.bincount(own, weight[begin:end], len(languages))
                labels.append(languages[int(per.argmax())])
                shares.append(float(per.max() / per.sum()))
                cuts = np.concatenate(([0], np.nonzero(np.diff(own))[0] + 1, [n]))
                spans.append(
                    [
                        {"first": int(a), "words": int(b - a), "lang": languages[own[a]]}
                        for a, b in zip(cuts, cuts[1:])
                    ]
                )
            kind = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry]
                + [
                    pa.array(labels, pa.string()),
                    pa.array(shares, pa.float64()),
                    pa.array(spans, pa.list_(kind)),
                ],
                carry + ["lang_pred", "score", "spans"],
            )


def identify(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs``, the language of each whole text and its spans.

    ``lang_pred`` is the language with most letters along the best path (of equal ones the first by name), ``score``
    its share of the letters, ``spans`` the runs ``first, words, lang`` of words between white
    space.  A text that is null or has no letter, or a model without languages, gives ``und``,
    score 0 and no spans.  Rows stand alone; no rows give no rows; columns not carried are
    ignored, one named like a result is left out.
    """
    carry, ddl = carried(docs, carry, {"lang_pred", "score", "spans", "_text"})
    taken = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("_text")
    )
    return taken.mapInArrow(
        partial(_label, model=model, carry=carry),
        ddl + "lang_pred string, score double, spans array<struct<first:long,words:long,lang:string>>",
    )


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; a row without id is none of them."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
