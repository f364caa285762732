import random
import re

import numpy as np
import pytest
from driftline.llm import neardup, shingles


def brute_set(t):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """doc_id -> smallest id reachable over links of 100 * intersection >= 75 * union."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(brute_set(t))
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def family(seed, n=60):
    """Copies, near copies of growing distance, chains, short and empty texts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(6, 200))]
        texts.append(" ".join(base))
        for _ in range(n // 6):
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                base[rnd.randrange(len(base))] = word()
            texts.append(" ".join(base) if rnd.random() < 0.8 else " ".join(base).upper())
    texts += ["", " \n", "one", "ONE", "one two", "one two three four", "one two three four", "é a b c d e", "É a b c d e"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_shingles_against_plain():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aB \n\té\x0b\x85") for _ in range(rnd.randint(0, 60))) for _ in range(2000)] + ["", "\n", "word " * 5000]
    got = shingles.shingle_sets(texts)
    seen = {}
    for t, h in zip(texts, got, strict=True):
        assert len(h) == len(brute_set(t))
        seen.setdefault(frozenset(brute_set(t)), set()).add(h.tobytes())
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_blocks_change_nothing(monkeypatch):
    texts = [t for _, t in family(3)] + ["w " * 500]
    want = shingles.shingle_sets(texts)
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(want, shingles.shingle_sets(texts), strict=True))


def test_pigeonhole():
    """All signatures within the guaranteed distance share a key."""
    rnd = np.random.default_rng(5)
    n = neardup.CHUNKS * neardup.WIDTH
    for _ in range(300):
        a = rnd.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
        b = a.copy()
        at = rnd.choice(n, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)
        b[at] += 1
        x, y = neardup.keys(np.array([a, b]))
        assert set(x) & set(y)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_plain(spark, seed):
    rows = family(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, rep int")
    want = brute(rows)
    for block in (256, 3):
        got = neardup.near_duplicates(df, block=block).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(brute_set(dict(rows)[r.doc_id])) for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, "q " * 30_000), (8, "q " * 30_001)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, -1, True), (1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (5, 3, False), (7, 7, True), (8, 7, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_hubs_of_far_texts(spark):
    """One group by a shared beginning, whose texts aren't all like the hub's but in part like each other."""
    rnd = random.Random(9)
    rows, n = [], 0
    for _ in range(4):
        base = [f"w{rnd.randint(0, 999)}" for _ in range(60)]
        for _ in range(40):
            base[rnd.randrange(len(base))] = f"x{rnd.randint(0, 999)}"
            rows.append((n, " ".join(base)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, block=4).collect()} == brute(rows)


def test_alike_against_plain():
    rnd = np.random.default_rng(3)
    for _ in range(500):
        a, b = (np.unique(rnd.integers(0, 30, rnd.integers(0, 25))).astype(np.uint64) for _ in range(2))
        x, y = set(a.tolist()), set(b.tolist())
        assert neardup.alike(a, b) == bool(x and y and 100 * len(x & y) >= 75 * len(x | y))


def test_deduplicated(spark):
    a, b = "a b c d e f g", "other words stand here now"
    rows = [(1, a), (5, a), (5, b), (5, b.upper()), (None, a), (None, a), (7, ""), (7, None), (8, b), (9, b + " x")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id int, text string, rep int, digest string")
    got = neardup.deduplicated(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == [(-1, a), (-1, a), (1, a), (5, b.upper()), (7, ""), (9, b + " x")]
    assert neardup.deduplicated(df.limit(0)).count() == 0
