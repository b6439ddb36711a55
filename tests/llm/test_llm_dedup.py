"""Near duplicates and line deduplication against brute force."""

import hashlib
import random
import string
import time

import pytest
from pyspark.sql import functions as F

from stationlake.llm import lines, near_duplicates

SCHEMA = "doc_id long, text string, kept string, n int, _row string"


def words(rng, n):
    return ["".join(rng.choices(string.ascii_lowercase, k=4)) for _ in range(n)]


def frame(spark, rows):
    """Documents with extra columns named like results."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def shingles(text, width):
    ws = [w.lower() for w in (text or "").encode().split()]
    if not ws:
        return set()
    if len(ws) < width:
        return {tuple(ws)}
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)}


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    links = [
        (a, b)
        for a, x in sets
        for b, y in sets
        if None not in (a, b) and a != b and x and y and 100 * len(x & y) >= 80 * len(x | y)
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted(
        ((i, len(s), label.get(i), i is None or label[i] == i) for i, s in sets), key=str
    )


def near(spark, rows, width=4):
    found = near_duplicates.near_duplicates(frame(spark, rows), width=width).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)


def edited(rng, base, share):
    out = list(base)
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = rng.choice(["neu", "alt", "rot"]) + str(rng.random())
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.randint(1, 90)))) for i in range(40)]
    bases = [words(rng, 120) for _ in range(3)]
    for i in range(90):  # families of copies whose members differ more or less from each other
        rows.append((100 + i, " ".join(edited(rng, bases[i % 3], rng.choice([0, 0.01, 0.03, 0.08])))))
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "One two"), (304, "one TWO"), (305, "ÉA b")]
    rows += [(306, "éa b"), (None, "one two"), (None, None), (303, "One two"), (7, rows[3][1])]
    rng.shuffle(rows)
    expected = brute(rows, 4)
    # rows of a repeated id go each by its own text
    assert near(spark, [r for r in rows if r[0] != 7 and r[0] != 303]) == brute(
        [r for r in rows if r[0] != 7 and r[0] != 303], 4
    )
    found = near(spark, rows)
    assert [r for r in found if r[0] not in (7, 303, 3, 304)] == [
        r for r in expected if r[0] not in (7, 303, 3, 304)
    ]
    assert sorted(r[2] for r in found if r[0] in (7, 3)) == [3, 3, 7]


def test_long_chain_and_large_group(spark):
    rng = random.Random(2)
    base = words(rng, 200)
    chain = []
    for i in range(30):  # neighbours are similar, the ends are not
        start = 4 * i
        chain.append((1000 - i, " ".join((base + words(random.Random(3), 200))[start : start + 150])))
    same = [(2000 + i, "the same words in every one of these texts") for i in range(300)]
    assert near(spark, chain + same) == brute(chain + same, 4)


def test_no_rows(spark):
    assert near(spark, []) == []
    assert lines.dedup_lines(frame(spark, [])).collect() == []
    assert lines.without_common_lines(frame(spark, [])).collect() == []


def test_signature_of_a_union_is_the_minimum():
    import numpy as np

    a = near_duplicates.shingle_set("a b c d e f g h", 2)
    b = near_duplicates.shingle_set("c d e x y z", 2)
    one = near_duplicates.signatures(a, np.array([0]), 32)[:, 0]
    two = near_duplicates.signatures(b, np.array([0]), 32)[:, 0]
    both = near_duplicates.signatures(np.union1d(a, b), np.array([0]), 32)[:, 0]
    assert (both == np.minimum(one, two)).all()
    assert len(set(one.tolist())) > 1


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for i, ls in docs:
        for key in {x.strip(strip).translate(lower) for x in ls}:
            if len(key) >= 40:
                holders.setdefault(key, []).append(-1 if i is None else i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, ls in docs:
        kept = [x for x in ls if last.get(x.strip(strip).translate(lower), i) == i]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    common = "A line of boilerplate that is LONG enough, É and all"
    rows = []
    for i in range(60):
        own = [" ".join(words(rng, 12)) for _ in range(4)]
        if i % 2:
            own.insert(rng.randint(0, 4), rng.choice([common, f"\t {common.replace('LONG', 'long')} \r"]))
        if i % 7 == 0:
            own += [common, common, "short line"]
        if i in (3, 5, 9, 11):
            own.append("exactly four documents have this line, so it stays in all")
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, common + "\n" + common), (8, rows[8][1])]
    found = lines.dedup_lines(frame(spark, rows)).selectExpr(
        "doc_id", "n_lines", "n_dropped", "sha2(kept_text, 256)"
    )
    assert sorted(map(tuple, found.collect()), key=str) == brute_lines(rows)


def test_stage_keeps_columns_and_untouched_texts(spark):
    common = "this very line stands in all of the five documents here"
    rows = [(i, f"own {i}\n{common}") for i in range(5)] + [(9, None)]
    docs = frame(spark, rows)
    out = lines.without_common_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.kept, r._row) for r in out.collect()}
    assert got[0] == ("own 0", "x", "y")
    assert got[4][0] == f"own 4\n{common}"
    assert got[9][0] is None


@pytest.mark.parametrize("text,width,n", [("a b c", 4, 1), ("a b c d", 4, 1), ("a b a b a b", 2, 2)])
def test_set_sizes(text, width, n):
    assert len(near_duplicates.shingle_set(text, width)) == n


def test_very_long_text(spark):
    rng = random.Random(5)
    long_text = " ".join(words(rng, 60_000))
    rows = [(1, long_text), (2, long_text + " end"), (3, "other words")]
    assert [(r[0], r[2]) for r in near(spark, rows)] == [(1, 1), (2, 1), (3, 3)]


def test_lines_of_a_long_document_take_time_in_proportion(spark):
    def seconds(n):
        rows = [(i, "\n".join(f"line number {j} of a document of many different lines" for j in range(n)))
                for i in range(6)]
        begin = time.perf_counter()
        found = lines.dedup_lines(frame(spark, rows)).agg(F.sum("n_dropped"), F.sum("n_lines")).first()
        assert tuple(found) == (5 * n, 6 * n)
        return time.perf_counter() - begin

    seconds(100)
    short, long = seconds(20_000), seconds(80_000)
    assert long < 8 * short + 2


def test_rows_that_share_an_id_lose_their_own_lines(spark):
    shared = "a line that all of these documents have in common"
    rows = [(1, f"x\n{shared}"), (1, f"{shared}\ny\n{shared}"), (None, shared), (None, f"q\n{shared}"), (2, shared), (1, f"x\n{shared}")]
    got = sorted((r.doc_id or 0, r.kept_text, r.n_dropped) for r in lines.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([(1, "x", 1), (1, "y", 2), (0, "", 1), (0, "q", 1), (2, shared, 0), (1, "x", 1)])
