import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from driftline.llm import codes, ledger, periodic, queries
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- vector codes ----------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(key, vector) to codes, errors and codebooks, every part against every entry."""
    wide = -(-max((len(v) for _, v in rows), default=1) // parts)
    v = [[*(math.floor(4096 * x) for x in own), *[0] * (wide * parts - len(own))] for _, own in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, v[k]))
    cut = [[own[p * wide : (p + 1) * wide] for own in v] for p in range(parts)]
    books = [[list(cut[p][k]) for k in order[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(p, x)[1] for x in cut[p]]
            for e in range(len(books[p])):
                mine = [x for x, n in zip(cut[p], own, strict=True) if n == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[nearest(p, cut[p][k]) for p in range(parts)] for k in range(len(rows))]
    return ["".join(f"{n:02x}" for _, n in f) for f in found], [sum(d for d, _ in f) for f in found], books


@pytest.mark.parametrize("spread", [3, 4000, 1 << 40, 1 << 62])
def test_assignment_against_all_distances(spread):
    rnd = np.random.default_rng(7)
    for t in range(40):
        n, dims, k = int(rnd.integers(1, 200)), int(rnd.integers(1, 9)), int(rnd.integers(1, 17))
        v = rnd.integers(-spread, spread, (n, dims))
        book = v[rnd.integers(0, n, k)] if t % 2 else rnd.integers(-spread, spread, (k, dims))
        tree = codes.build(v, leaf=4)
        owner, count, high, low, _ = codes.assign(tree, book)
        away = ((v.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(2)
        got = np.empty(n, int)
        got[tree["order"]] = owner
        assert (got == away.argmin(1)).all()
        for e in range(k):
            want = [int(x) for x in v.astype(object)[got == e].sum(0)] if (got == e).any() else [0] * dims
            assert count[e] == (got == e).sum() and [int(a) * (1 << 32) + int(b) for a, b in zip(high[e], low[e], strict=True)] == want


def test_whole_subtrees_are_assigned():
    """Where parts stand in groups, few of them meet an entry themselves."""
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-4000, 4000, (16, 8))
    v = centres[rnd.integers(0, 16, 4000)] + rnd.integers(-40, 40, (4000, 8))
    assert codes.assign(codes.build(v), centres)[4] < 0.1 * 4000 * 16


@pytest.mark.parametrize("n", [0, 1, 9, 260])
def test_codes_against_plain(spark, n):
    rnd = random.Random(n)
    rows = [(k if k % 13 else None, k % 3 if k % 4 else None, [rnd.choice([rnd.gauss(0, 1), 0.25, -0.5]) for _ in range(16 if k % 7 else 11)], "x") for k in range(n)]
    rows += [(r[0], *r[1:]) for r in rows[:5]]  # rows that repeat
    bad = [(-1, 1, None, "x"), (-2, 1, [1.0, None], "x"), (-3, None, [float("nan")] * 16, "x"), (-4, 2, [float("inf")], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, label int, embedding array<float>, salt string").repartition(3)
    rows = [(k, own) for k, _, own, _ in spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, salt string").collect()] if rows else []
    coded, books = codes.compress(df, "embedding", per_block=50)
    got = codes.with_group_error(coded, "label", salts=3).collect()
    want_codes, want_errors, want_books = plain_codes(rows)
    assert [[[int(x) for x in e] for e in b] for b in books] == want_books
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error) for r in got) == sorted((k is None, k or 0, c, e) for (k, _), c, e in zip(rows, want_codes, want_errors, strict=True))
    for label in {r.label for r in got}:
        own = [r for r in got if r.label == label]
        assert {r.label_error for r in own} == {sum(r.error for r in own)} and all(r.salt == "x" for r in own)


def test_codes_of_far_numbers(spark):
    rows = [(k, [(-1.0) ** k * 1e30, float(k), -3e14]) for k in range(20)]
    coded, books = codes.compress(spark.createDataFrame(rows, "vec_id long, v array<double>"), "v", rounds=2)
    assert all(r.error <= codes.MOST for r in coded.collect()) and len(books) == 8 and coded.columns == ["vec_id", "code", "error"]


# --- periodic runs ---------------------------------------------------------------------------------------------------


def plain_runs(w, least=12):
    found = set()
    for p in range(1, len(w) // 2 + 1):
        k = 0
        while k < len(w) - p:
            first = k
            while k < len(w) - p and w[k] == w[k + p]:
                k += 1
            start, end = first, k + p
            if end - start >= max(least, 2 * p) and not any(all(w[x] == w[x + q] for x in range(start, end - q)) for q in range(1, p)):
                found.add((start, end - start, p))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("near", [1, 2, 12])
def test_runs_against_plain(monkeypatch, near):
    monkeypatch.setattr(periodic, "NEAR", near)
    rnd = random.Random(near)
    for _ in range(1500):
        n, kinds, least = rnd.randint(0, 50), rnd.choice([1, 2, 2, 3, 6]), rnd.choice([2, 4, 12])
        w = [rnd.randrange(kinds) for _ in range(n)]
        if n > 4 and rnd.random() < 0.5:
            a, p = rnd.randrange(n), rnd.randint(1, n // 2)
            w = w[:a] + [w[(a + k % p) % n] for k in range(n - a)]
        assert periodic.runs(w, least) == plain_runs(w, least), w


def test_runs_where_hashes_are_equal_by_chance(monkeypatch):
    """Hashes that tell nothing: the words decide."""
    monkeypatch.setattr(periodic, "_mixed", lambda x: np.zeros(len(x), np.uint64))
    rnd = random.Random(2)
    for _ in range(200):
        base = [rnd.randrange(3) for _ in range(rnd.randint(1, 30))]
        w = [base[k % len(base)] if rnd.random() < 0.98 else 9 for k in range(rnd.randint(50, 200))]
        assert periodic.runs(w) == plain_runs(w)


def test_very_long_repetitive_texts():
    a, b = [0], [0, 1]
    while len(b) < 60000:
        a, b = b, b + a
    assert periodic.runs([5] * 200000) == [(0, 200000, 1)]
    assert len(periodic.runs(b)) > 1000 and periodic.runs(list(range(50000)) * 2) == [(0, 100000, 50000)]


def test_periodic_rows(spark):
    long = " ".join(["a b c"] * 9)
    rows = [(1, long, "x"), (1, long, "y"), (None, None, None), (2, "", "z"), (3, f"u {long} v\t{long}\n", "z"), (4, "x " * 11, ""), (5, "é " * 12, "")]
    df = spark.createDataFrame(rows, "id long, text string, runs string")
    got = sorted(((r.id or 0), [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic(df).collect())
    assert got == [(0, [], ""), (1, [(0, 27, 3)], "a b c"), (1, [(0, 27, 3)], "a b c"), (2, [], ""), (3, [(1, 27, 3), (29, 27, 3)], "u a b c v a b c"), (4, [], " ".join("x" * 11)), (5, [(0, 12, 1)], "é")]
    assert periodic.periodic(df.limit(0)).count() == 0


def test_lyndon_runs_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_lyndon_runs(spark, DIR).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = plain_runs(words) if n < 1500 else [tuple(x) for x in periodic.runs(periodic.numbered(words))]
        dropped = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert r.n_runs == len(found) and (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest()
    assert any(r.n_runs for r in got.values())


# --- rules -----------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count = {x: windows.count(x) for x in set(windows)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = {k + n for k, x in enumerate(windows) if count[x] > 1 for n in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(repeat)


def test_measures_against_plain(spark):
    rnd = random.Random(4)
    pieces = ["a", "b", "ab", "é", "日本", "𝒳", "#", "<>", " ", "$%", "x" * 50]
    texts = [None, "", " \n\t ", "\n\n", "a b c d", "a b c d e", "a " * 9, "a " * 400, "l\nl\n l\nl", "  a\x85b"]
    texts += ["".join(rnd.choice(pieces[: rnd.choice([2, 4, 11])]) + rnd.choice([" ", " ", "\n", "\t", "\x0b", "\x0c\r"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(k if k % 5 else None, t, "own", 7) for k, t in enumerate(texts)], "doc_id long, text string, measured string, n_words int")
    got = ledger.ledger(df.coalesce(1).withColumn("row", F.monotonically_increasing_id())).orderBy("row").collect()
    assert [tuple(r[m] for m in ledger.MEASURES) for r in got] == [plain_measures(t) for t in texts]
    assert all(r.measured == "own" for r in got)
    for r in got:
        fails = [r.n_words < 10, 100 * r.n_repeat_words > 20 * r.n_words, 10 * r.n_symbols > 3 * r.n_words, 100 * r.n_dup_lines > 50 * r.n_lines, r.word_chars > 40 * r.n_words]
        assert r.failures == sum(1 << k for k, x in enumerate(fails) if x)


def test_repeated_words_of_a_long_text(spark):
    rnd = random.Random(3)
    text = " ".join(rnd.choice("abcdefghijkl") for _ in range(60000))
    w = text.split(" ")
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    want = len({k + n for own in seen.values() if len(own) > 1 for k in own for n in range(5)})
    assert ledger.ledger(spark.createDataFrame([(1, text)], "id long, text string")).first().n_repeat_words == want


def test_ledger_runs_without_python(spark):
    for df in (queries.op13_rule_ledger(spark, DIR), queries.op13_rule_ablations(spark, DIR)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert "Exchange" not in queries.op13_rule_ledger(spark, DIR)._jdf.queryExecution().toString()


def test_ablations_against_policies(spark):
    rows = ledger.ledger(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text"))
    bits = [r.failures for r in rows.select("failures").collect()]
    for policy, mask in ledger.POLICIES.items():
        got = {r.rule: r for r in ledger.ablations(rows, policy).collect()}
        assert set(got) == {n for n, b in ledger.BIT.items() if b & mask}
        for name, r in got.items():
            b = ledger.BIT[name]
            assert (r.n_rows, r.n_failed, r.n_only) == (len(bits), sum(x & b > 0 for x in bits), sum(x & mask == b for x in bits))
            assert r.n_rejected_without == sum(x & mask & ~b > 0 for x in bits) and r.never == (not r.n_failed) and r.always == (r.n_failed == len(bits))
        assert rows.where(~ledger.passes(policy)).count() == sum(x & mask > 0 for x in bits)
    assert {(r.n_rows, r.n_failed, r.never) for r in ledger.ablations(rows.limit(0)).collect()} == {(0, 0, True)}


def test_clean_documents_are_kept(spark):
    """The rules beyond the base ones reject no document that is labelled good, and half of the others at least."""
    found = queries.op13_rule_ledger(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept for r in found if r.quality == 1)
    bad = [r for r in found if r.quality == 0]
    assert sum(not r.kept for r in bad) * 3 > len(bad)
