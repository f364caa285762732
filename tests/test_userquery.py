import math
import sqlite3

import pytest
from driftline.functions.stem import analyzed, stem
from driftline.operators import fts
from driftline.plans.userquery import Node, Page, Phrase, is_site_name, page_of, parse, suggestion, wants_encyclopedia, within_site


def P(*w):
    return Phrase(w)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("cats AND dogs", Node("AND", P("cats"), P("dogs"))),
        ("(cats OR dogs) NOT birds", Node("NOT", Node("OR", P("cats"), P("dogs")), P("birds"))),
        ("one two NOT three", Node("NOT", Node("AND", P("one"), P("two")), P("three"))),
        ("a OR b AND c", Node("OR", P("a"), Node("AND", P("b"), P("c")))),
        ('"big cats" don\'t', Node("AND", P("big", "cats"), P("don", "t"))),
        ('"dangling quote', P("dangling", "quote")),
        ("cats AND", Node("AND", P("cats"), P("and"))),
        ("and or not", Node("AND", Node("AND", P("and"), P("or")), P("not"))),
        ("(a", P("a")),
        ("a) b", Node("AND", P("a"), P("b"))),
        ("()", None),
        ("foo-bar", P("foo", "bar")),
        ("", None),
    ],
)
def test_expressions(raw, want):
    assert parse(raw).expression == want


def test_scopes():
    q = parse('  Site:x  cats site:Example.org filetype:PDF intitle:"Many Words" inurl:abc  ')
    assert (q.site, q.filetype, q.title, q.url) == ("example.org", "pdf", "many words", "abc")
    assert not q.is_simple and q.valid_for_text and not q.valid_for_images
    only = parse("site:a.b")
    assert only.expression is None and only.valid_for_text and only.valid_for_images
    assert not parse("   ").valid_for_text
    assert suggestion(parse("cats dogs site:a.b")).raw == "site:a.b cats OR dogs" and suggestion(parse("cats")) is None
    assert within_site("x", "a.b") == "site:a.b x" and is_site_name("a.b") and not is_site_name("ab") and not is_site_name("-.")
    assert wants_encyclopedia(parse("two words")) and not wants_encyclopedia(parse("a b c")) and not wants_encyclopedia(parse("a"), 2)


def test_pages():
    assert Page(3).offset == 30 and Page(1).has_next(16) and not Page(1).has_next(15)
    assert page_of("/search/p:4/").number == 4 and page_of("/search").number == 1


CORPUS = [("one", "the quick brown fox jumps over the lazy dog"), ("two", "quick quick dogs and a brown cat"), ("three", "nothing of that kind here at all"), ("four", "a fox is a fox is a fox"), ("brown", "cats chase dogs over fields"), ("six", "the end of the day the fox sleeps")]


@pytest.mark.parametrize("raw", ["fox", "quick brown", "quick OR fox", '"the fox"', '"brown fox" OR cat', "fox NOT dog", "(quick OR cats) AND dogs", "of the", '"fox is a fox"'])
def test_matches_and_scores_of_sqlite(spark, raw):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table fts using fts5(title, body, tokenize='unicode61')")
    con.executemany("insert into fts(rowid, title, body) values (?, ?, ?)", [(i, *r) for i, r in enumerate(CORPUS)])
    quoted = " ".join(w if w in ("AND", "OR", "NOT") or '"' in raw or "(" in raw else f'"{w}"' for w in raw.split(" "))
    want = {i: r for i, r in con.execute("select rowid, bm25(fts) from fts where body match ?", (quoted,))}
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(CORPUS)], "url_id long, title string, body string")
    got = {r.url_id: r["rank"] for r in fts.matched(docs, parse(raw)).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in got)


def test_postings_give_the_same_scores(spark):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(CORPUS)], "url_id long, title string, body string")
    lengths = [len(f"{t} {b}".split()) for t, b in CORPUS]
    got = {r.url_id: r["rank"] for r in fts.from_postings(fts.postings(docs), ["quick", "fox"], len(CORPUS), sum(lengths) / len(lengths)).collect()}
    want = {r.url_id: r["rank"] for r in fts.matched(docs, parse("quick OR fox")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)


def test_stems_of_sqlite():
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running generalizations oscillators be is a".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table fts using fts5(body, tokenize='porter unicode61')")
    con.execute("create virtual table terms using fts5vocab(fts, 'row')")
    for w in words:
        con.execute("delete from fts")
        con.execute("insert into fts values (?)", (w,))
        assert stem(w) == con.execute("select term from terms").fetchone()[0], w
    assert analyzed("Cafés Running") == ["cafe", "run"]


NATURAL = [("Cafés", "cats were running over the hills"), ("two", "a cat runs; the café is closed"), ("three", "Straßen und Wege, cafés and naïve connections"), ("running", "nothing of that kind, connected or not"), ("five", "dogs sleep here")]


@pytest.mark.parametrize("raw", ["running", "cats", "cafe", '"cat running"', "cat NOT hill", "connecting OR cafés", "naive", "straßen"])
def test_stemmed_search_of_sqlite(spark, raw):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table fts using fts5(title, body, tokenize='porter')")
    con.executemany("insert into fts(rowid, title, body) values (?, ?, ?)", [(i, *r) for i, r in enumerate(NATURAL)])
    want = {i: r for i, r in con.execute("select rowid, bm25(fts) from fts where body match ?", (raw,))}
    docs = spark.createDataFrame([(i, *r, f"u{i}", 0, 0.0, 4) for i, r in enumerate(NATURAL)], "url_id long, title string, body string, url string, external_inbound_links int, popularity_rank double, content_type int")
    got = {r.url_id: (r["rank"], r.snippet) for r in fts.text_search(docs, parse(raw)).collect()}
    assert got.keys() == want.keys() and fts.result_count(docs, parse(raw)).first().n == len(want)
    assert all(math.isclose(got[i][0], want[i], rel_tol=1e-6, abs_tol=1e-9) and "[" in got[i][1] for i in got)
    if parse(raw).expression == P(raw):
        lengths = [len(analyzed(f"{t} {b}")) for t, b in NATURAL]
        index = fts.from_postings(fts.postings(docs), [raw], len(NATURAL), sum(lengths) / len(lengths))
        assert {r.url_id: round(r["rank"], 9) for r in index.collect()} == {i: round(r, 9) for i, r in want.items()}


def test_stems_of_odd_words():
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table fts using fts5(body, tokenize='porter unicode61')")
    con.execute("create virtual table terms using fts5vocab(fts, 'row')")
    for w in ["mp3s", "großes", "eed", "ies", "ệs", "Ćwiczenia", "й", "ſet", "İs", "한국", "a" * 70 + "ing"]:
        con.execute("delete from fts")
        con.execute("insert into fts values (?)", (w,))
        assert analyzed(w) == [r[0] for r in con.execute("select term from terms")], w
