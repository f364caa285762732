import random
import struct
import zlib
from array import array
from functools import cache

import pytest
from driftline.llm import sentencepieces, tokcount
from driftline.llm.encode import Encoder, public
from hypothesis import given, settings
from hypothesis import strategies as st

ODD = ["", "  ", "a  b", "x\n\n  y", " lead", "trail  ", "<|endoftext|> a", "foo  <|endoftext|>bar", "İstanbul ſ 'S it's WE'LL", "日本語 テスト é ́x", "a\x1cb \x1d c", "\x85a\xa0b", "ﬀ ½ ² 3½", "'s's ''s", "ŉ ǆ", "Σας ΑΣ", "<|startoftext|>x", "▁a ▁▁b", "é" * 300]


def mixed_texts(n=1500, seed=1):
    rnd = random.Random(seed)
    letters = "ab 'sté\n\t.,<|>ÀñÖ0½1́中▁  in"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def enc(request):
    return Encoder(public(request.param))


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Model(public("piece_bpe_32k.model"))


def test_ids_are_the_librarys(enc):
    assert enc.ranked is not None
    for t in mixed_texts():
        want = enc.library.encode(t, add_special_tokens=False).ids
        assert list(array("I", enc.ids(t))) == want, t
        assert enc.count(t) == len(want)


@cache
def byte_encoder():
    return Encoder(public("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    enc = byte_encoder()
    assert list(array("I", enc.ids(t))) == enc.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("window", "overlap"), [(200, 40), (97, 8), (512, 64), (64, 64)])
def test_windows_agree_with_the_whole(enc, window, overlap):
    rnd = random.Random(3)
    long = ["x" * 3000, "ab" * 900 + " " + "é" * 2000, "<|endoftext|>" * 300, " " * 900 + "a" * 10 + "\n" * 500, ("a" * 37 + "<|endoftext|>" + "  ") * 80]
    long += ["".join(rnd.choice(["a", "b ", "\n", "'s", "<|endoftext|>", "é", "  ", "中"]) for _ in range(2000)) for _ in range(4)]
    for t in long:
        assert tokcount.count_huge(enc, t, window, overlap) == enc.count(t)


def test_texts_without_spaces_are_cut_too():
    """Windows stay as long as they are where no white space and, in the last texts, no pre-token border ever comes."""
    enc, rnd = Encoder(public("byte_bpe_50k.json")), random.Random(4)
    pools = ["あいうえおかきくけこ日本語の文章漢字、。", "abcdefgh01239+/", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこ日本語の文章漢字", "éàöüaeiñ"]
    for pool in pools:
        text = "".join(rnd.choices(pool, k=60_000))
        longest, cuts = [], enc.cuts
        enc.cuts = lambda t, longest=longest, cuts=cuts: longest.append(len(t)) or cuts(t)
        assert tokcount.count_huge(enc, text, 4096, 256) == enc.count(text), pool
        del enc.cuts
        assert max(longest) <= 4096 and sum(longest) < 1.3 * len(text), pool


def test_long_runs_are_not_kept(enc, pieces):
    text = "x" * 5000 + " " + "y" * 70 + " z"
    enc.count(text), enc.ids(text), pieces.encode([text])
    assert max(map(len, [*enc.by_run, *enc.n_by_run, *pieces.kept])) <= 65


def test_simple_texts_are_the_librarys():
    """Texts of white space, ASCII and letters, with contractions, digits, signs and special strings next to each other."""
    enc, rnd = Encoder(public("word_bpe_49k.json")), random.Random(8)
    parts = ["'", "'s", "'LL", "d", "Re", "é", "Œuvre", "ŸŽ", "ß", "1", "23", ".", ",", "?!", "_", "<", "|", "<|", "|>", "<|endoftext|>", "(", " ", "\n", "\t", "the"]
    texts = ["", "'", "a", "1", "don't, 'tis", "('s 'S''s", "a1b2,3", "x.'s", "'1's1't", "É'É,é"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        assert list(array("I", enc.ids(t))) == enc.library.encode(t, add_special_tokens=False).ids, t


def test_a_word_is_made_once_however_it_is_written():
    enc = Encoder(public("word_bpe_49k.json"))
    made, make = [], enc.make
    enc.make = lambda run: made.append(run) or make(run)
    for text in ["Ndshan blorêa.", "ndshan, blorêa", "NDSHAN blorêa; ndshan?", "(Blorêa) ndshan"]:
        assert list(array("I", enc.ids(text))) == enc.library.encode(text, add_special_tokens=False).ids
    assert sorted(x for x in made if x[0].isalpha()) == ["blorêa", "ndshan"]


def test_pieces_are_the_librarys(pieces):
    texts = mixed_texts(seed=2)
    for t, ids, want in zip(texts, pieces.encode(texts), pieces.library.encode(texts), strict=True):
        assert list(ids) == want, t
        assert pieces.decode(ids) == pieces.library.decode(want) == t.replace("▁", " ")


def test_generations_change_nothing(pieces, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT", 50)
    monkeypatch.setattr(sentencepieces, "PAIRS", 50)
    texts = mixed_texts(400, seed=5)
    for at in range(0, len(texts), 20):
        block = texts[at : at + 20]
        assert [list(x) for x in pieces.encode(block)] == pieces.library.encode(block)


def test_pair_test_is_merging(pieces):
    rnd = random.Random(6)
    ids = [i for i in pieces.ids.values() if len(pieces.piece[i]) < 9]
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        x, y = pieces.piece[a], pieces.piece[b]
        if pieces.merged(x) == [x] and pieces.merged(y) == [y]:
            assert pieces._follows(a, b) == (pieces.merged(x + y) == [x, y])


def test_unigram_forward_scores():
    """Against trying all ways to cut a word, with the pieces' scores taken as a unigram model's."""
    m = sentencepieces.Model(public("piece_bpe_32k.model"), unigram=True)

    def best(w):
        if not w:
            return 0.0
        cuts = [m.score[m.ids[w[:n]]] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in m.ids]
        return max(cuts)

    words = sorted({"▁the", "▁there", "▁then", "▁thistle", "▁in", "▁inner", "inside", "▁a"})
    for w, ids in m.words(words).items():
        assert "".join(m.piece[i] for i in ids) == w
        assert sum(m.score[i] for i in ids) == pytest.approx(best(w))


def test_queries_on_odd_rows(spark):
    rows = [(1, ""), (2, None), (None, "a b"), (3, "the end"), (3, "the end"), (4, "x" * 50_000), (5, "<|endoftext|>"), (6, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    got = tokcount.count_tokens(df, public("byte_bpe_50k.json")).collect()
    lib = Encoder(public("byte_bpe_50k.json")).library
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or -1, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    assert tokcount.count_tokens(df.limit(0), public("byte_bpe_50k.json")).count() == 0
    sp = sentencepieces.digests(df, public("piece_bpe_32k.model")).collect()
    assert len(sp) == len(rows) and all(r.round_trip for r in sp)
    plain = sentencepieces.Model(public("piece_bpe_32k.model")).library
    want = [(i or -1, len(x := plain.encode(t or "")), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, t in rows]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in sp) == sorted(want)
    ids = sentencepieces.encode(df, public("piece_bpe_32k.model"))
    back = sentencepieces.decode(ids, public("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in rows)
    assert sentencepieces.digests(df.limit(0), public("piece_bpe_32k.model")).count() == 0
