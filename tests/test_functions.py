import random
import struct

from driftline.functions import formats, gemtext, parsers, text, urls
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


GEM = "# \nintro #Tag, #12 @name here ~me \n```alt text\n# Inside\n=> /in in\n```\n## Real Title\n=> /a First\n=> gemini://other.org/b 2021-01-02 A dated entry\n=> https://web.org/ Web\n=> c\n=>   /d 2021-02-03 Another dated one\ntail\n"


def test_gemtext(spark):
    lines = lambda x: gemtext.lines(x)
    assert one(spark, GEM, lambda x: gemtext.title(lines(x))) == "Inside"
    assert one(spark, "text\n```only alt\nx\n```", lambda x: gemtext.title(lines(x))) == "only alt" and one(spark, "no title", lambda x: gemtext.title(lines(x))) is None
    assert "# Inside" not in one(spark, GEM, lambda x: gemtext.outside_fences(lines(x)))
    assert one(spark, "a\n```\nb\nc", lambda x: gemtext.indexable(lines(x))) == "a\n" and one(spark, "```\nb\n```", lambda x: gemtext.indexable(lines(x))) == ""
    found = one(spark, GEM, lambda x: gemtext.links(lines(x)))
    assert [(p.target, p.link_text) for p in found][1:] == [("/a", "First"), ("gemini://other.org/b", "2021-01-02 A dated entry"), ("c", ""), ("/d", "2021-02-03 Another dated one")]
    assert one(spark, GEM, lambda x: gemtext.is_feed(gemtext.links(lines(x)))) is True
    out = lambda x: gemtext.outside_fences(lines(x))
    assert one(spark, GEM, lambda x: gemtext.hashtags(out(x))) == ["tag"] and one(spark, GEM, lambda x: gemtext.mentions(out(x))) == ["name"]
    tags = "#first a #foo-bar,#b2 #x #2021-22 #abc #a1B2c3\n=> /a#frag b #in-link\n### head #Deep\n```\n# x #hidden\n```\nlast #end_"
    assert one(spark, tags, lambda x: gemtext.hashtags(out(x))) == ["b2", "deep", "end_", "foo-bar", "in-link"]
    names = "@first said,~second and @a.b @3rd @ab\n=> /x @nobody_ here @last"
    assert one(spark, names, lambda x: gemtext.mentions(out(x))) == ["first", "last", "nobody_", "second"]
    assert one(spark, "text\n#### Foo", lambda x: gemtext.title(lines(x))) == "Foo"
    for text, want in (("```", []), ("```a", []), ("a\n```", ["a"]), ("```\n```", []), ("```\na\n```\nb", ["b"]), ("a\n```x\nb\n```y\nc\n```\nd", ["a", "c"]), ("", [""]), ("a\n\nb", ["a", "", "b"]), ("```\n```\n```\nx", []), (" ```\nx", [" ```", "x"])):
        assert one(spark, text, out) == want, text
    dates = lambda *x: one(spark, "\n".join(f"=> /a {d} text" for d in x), lambda v: gemtext.is_feed(gemtext.links(lines(v))))
    assert dates("2021-12-31", "1999-01-01") is True and dates("2021-99-99", "2021-20-01", "2021-01-45") is False


def test_urls(spark):
    u = "Gemini://Example.ORG:1965/A/b_File.GMI?q=1#x"
    got = spark.createDataFrame([(u,)], "u string").select(*[f(F.col("u")).alias(f.__name__) for f in (urls.protocol, urls.domain, urls.port, urls.path, urls.query, urls.extension, urls.normalized, urls.authority)]).first()
    assert tuple(got) == ("gemini", "example.org", 1965, "/A/b_File.GMI", "q=1", "gmi", "gemini://example.org/A/b_File.GMI?q=1", "example.org:1965")
    assert one(spark, "gemini://h", urls.normalized) == "gemini://h/" and one(spark, "gemini://h/robots.txt", urls.is_special) is True
    assert one(spark, "/pics/myCat-photo_Big.PNG", urls.path_words) == ["my", "Cat", "photo", "Big", "pics"]
    assert one(spark, "/NASA/a%2Db", urls.path_words) == ["a", "b", "NASA"]


def test_resolved_links(spark):
    """As the standard library resolves links of the web, for which it knows the rules."""
    from urllib.parse import urljoin

    bases = ["h", "h/", "h/a", "h/a/b", "h/a/b/", "h/a/../b/c?q=1#f", "h:70/x?y/z#t/u", "h?q"]
    targets = ["", "c", "c/", "./c", "../c", "../../../c", "..", ".", "./", "../", "c/./d/../e", "/c", "/c/../d", "/..", "?x", "c?x/../y", "#f", "c#f/..", "?x#y", "//o/p", "//o", "c;p=1", "c d", "é", "...", "/.", "a/..", "../a/.", ".c"]
    pairs = [(f"http://{b}", x) for b in bases for x in targets]
    df = spark.createDataFrame(pairs, "base string, target string")
    got = {(r.base, r.target): r.url for r in df.select("base", "target", urls.resolve(F.col("base"), F.col("target")).alias("url")).collect()}
    for (b, x), url in got.items():
        assert url == urljoin(b, x) or (x in ("", "#f") and url.split("#")[0] == b.split("#")[0]), (b, x, url, urljoin(b, x))
    odd = spark.createDataFrame([("gemini://h/a", "mailto:x"), ("gemini://h/a", "gemini://o/../x"), ("gemini://h/a", "gemini:///x"), ("none", "c"), (None, "c"), ("gemini://h/", None), ("gemini://h/a", "//"), ("gemini://h/a", "x:y"), ("gemini://h/", "a//../b"), ("gemini://h", "/a//b")], "b string, t string")
    assert [r.url for r in odd.select(urls.resolve(F.col("b"), F.col("t")).alias("url")).collect()] == [None, "gemini://o/../x", None, None, None, None, None, None, "gemini://h/a/b", "gemini://h/a//b"]


def test_archived_links(spark):
    lines = ["=> c text", "```", "=> c inside", "```x", "=> ../d", "plain", "", "=> https://web/ w", "=> gemini://o/p q\u2028r", "```", "=> open"]
    got = spark.createDataFrame([(lines,), ([],), ([""],), (["```"],), (["=> /x"],)], "l array<string>").select(parsers.archive_links(F.col("l"), F.lit("gemini://h/a/b"), F.lit(5)).alias("x")).collect()
    to = "=> /archive/cached?url=gemini%3A%2F%2F{}&t=5 "
    assert got[0].x == [to.format("h%2Fa%2Fc") + "text", *lines[1:4], to.format("h%2Fd"), "plain", "", lines[7], to.format("o%2Fp") + "q\u2028r", "```", "=> open"]
    assert [r.x for r in got[1:]] == [[""], [""], ["```"], [to.format("h%2Fx")]]
    many = ["=> /x y", "```", "=> /in", "```"] * 20000
    assert len(spark.createDataFrame([(many,)], "l array<string>").select(parsers.archive_links(F.col("l"), F.lit("gemini://h/"), F.lit(1)).alias("x")).first().x) == 80000


def test_formats(spark):
    n = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 << 20,), (3 << 30,)], "n long").select(formats.human_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in n] == ["0 bytes", "1023 bytes", "1 KB", "1.50 KB", "5 MB", "3 GB"]
    assert one(spark, "ab12", formats.fingerprint_hex) == "AB:12" and one(spark, " a\r\nb ", formats.one_line) == "ab"
    assert one(spark, "x" * 200, formats.lead) == "x" * 99 and one(spark, "", formats.lead) == ""
    for body, want in ((b"plain\n", True), (b"\xef\xbb\xbf\x00", True), (b"\x00abc", False), (b"a\x1b[0m", True), (b"a\x0e", False), (b"\x10\x20", False), ("é".encode(), True)):
        assert spark.createDataFrame([(bytearray(body),)], "b binary").select(formats.is_text(F.hex("b"))).first()[0] is want, body
    assert str(one(spark, "http://a/web/20200102030405id_/gemini://x/", formats.wayback_time)) == "2020-01-02 03:04:05" and one(spark, "http://a/web/20200102030405id_/gemini://x/", formats.wayback_source) == "gemini://x/"


def test_text():
    assert text.snippet("alpha beta gamma delta", [("gamma",)], 2, text.fold) == "…[gamma] delta"
    assert text.snippet("Café au lait", [("cafe",)], 20, text.fold) == "[Café] au lait" and text.snippet("", [("x",)], 20, text.fold) == ""
    changes = text.line_changes("a\nb\nc", "a\nx\nc\nd")
    assert changes == [(1, "Unchanged", "a"), (None, "Deleted", "b"), (2, "Inserted", "x"), (3, "Unchanged", "c"), (4, "Inserted", "d")]
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 5, 8, 6, 0, 0, 0)
    assert text.image_info(png) == (7, 5, "PNG", True) and text.image_info(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4, "GIF", False) and text.image_info(b"nope") is None
    assert text.language_of("the house of the man that was on the hill with his dog and " * 5) == "en" and text.language_of("short") is None


def test_emoji(spark):
    rows = ["🚀", "👨‍👩‍👧", "🇩🇪", "1️⃣", "👍🏽", "🚀🚀", "ab", "", " 🚀", "é"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").select("i", text.is_one_emoji(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [True] * 5 + [False] * 5


def test_parsed_responses(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 5, 8, 2, 0, 0, 0)
    rows = [
        ("gemini://h/a", 20, "text/gemini", "text/gemini", GEM.encode()), ("gemini://h/r", 31, "gemini://x/", None, b""), ("gemini://h/i", 20, "image/png", "image/png", png),
        ("gemini://h/p", 20, "text/plain", "text/plain", b"one\ntwo"), ("gemini://h/robots.txt", 20, "text/plain", "text/plain", b"User-agent: *"), ("gemini://h/b", 20, "application/x", "application/x", b"\x00\x01"),
    ]
    df = spark.createDataFrame([(u, s, m, t, bytearray(b)) for u, s, m, t, b in rows], "url string, status_code int, meta string, mime_type string, body binary")
    got = {r.url[11:]: r for r in parsers.parsed(df).collect()}
    assert [got[k].content_type for k in ("a", "r", "i", "p", "b")] == [parsers.GEMTEXT, parsers.PLAIN, parsers.IMAGE, parsers.PLAIN, parsers.BINARY]
    assert got["i"].image.width == 7 and got["p"].indexable == "one\ntwo" and got["robots.txt"].indexable is None and got["a"].is_feed and got["r"].links[0].target == "gemini://x/"
    found = {(r.target, r.is_external) for r in parsers.found_links(df).collect()}
    assert {("gemini://h/a", False), ("gemini://other.org/b", True), ("gemini://x/", True)} <= found and ("https://web.org/", True) not in found


def test_html_and_archive(spark):
    assert parsers.reversed_html("<h2>Head</h2><p>Some <b>text</b> and <a href='/x'>a link</a></p><p><a href='/y'>alone</a></p><ul><li>one</li></ul><pre>a\n b</pre><script>no</script>") == "## Head\nSome text and a link\n=> /x a link\n=> /y alone\n* one\n```\na\n b\n```"
    lines = one(spark, "=> /a First\n```\n=> /b\n```\n=> https://w/ web", lambda x: parsers.archive_links(F.split(x, "\n"), F.lit("gemini://h/d/e"), F.lit(5)))
    assert lines == ["=> /archive/cached?url=gemini%3A%2F%2Fh%2Fa&t=5 First", "```", "=> /b", "```", "=> https://w/ web"]


def test_fourteen_languages():
    # texts that aren't in the samples
    texts = {
        "en": "Yesterday we walked along the river until it started to rain, and then we sat under a bridge and talked about the books that our teacher had given us in the spring.",
        "de": "Gestern gingen wir am Fluss entlang, bis es zu regnen begann, und dann saßen wir unter einer Brücke und sprachen über die Bücher, die uns der Lehrer im Frühling gegeben hatte.",
        "fr": "Hier nous avons marché le long de la rivière jusqu'à ce qu'il commence à pleuvoir, puis nous nous sommes assis sous un pont et avons parlé des livres que le professeur nous avait donnés.",
        "es": "Ayer caminamos por la orilla del río hasta que empezó a llover, y luego nos sentamos debajo de un puente y hablamos de los libros que el profesor nos había dado en la primavera.",
        "it": "Ieri abbiamo camminato lungo il fiume finché non ha cominciato a piovere, poi ci siamo seduti sotto un ponte e abbiamo parlato dei libri che il maestro ci aveva dato in primavera.",
        "pt": "Ontem caminhámos ao longo do rio até que começou a chover, e depois sentámo-nos debaixo de uma ponte e falámos dos livros que o professor nos tinha dado na primavera passada.",
        "nl": "Gisteren liepen we langs de rivier totdat het begon te regenen, en daarna zaten we onder een brug en spraken we over de boeken die de leraar ons in het voorjaar had gegeven.",
        "sv": "Igår gick vi längs floden tills det började regna, och sedan satt vi under en bro och pratade om böckerna som läraren hade gett oss på våren, innan skolan stängde för sommaren.",
        "da": "I går gik vi langs floden, indtil det begyndte at regne, og så sad vi under en bro og talte om de bøger, som læreren havde givet os i foråret, før skolen lukkede for sommeren.",
        "no": "I går gikk vi langs elven til det begynte å regne, og så satt vi under en bro og snakket om bøkene som læreren hadde gitt oss på våren, før skolen stengte for sommeren.",
        "ru": "Вчера мы гуляли вдоль реки, пока не начался дождь, а потом сидели под мостом и разговаривали о книгах, которые учитель дал нам весной, перед тем как школа закрылась на лето.",
        "ja": "昨日、私たちは雨が降り始めるまで川に沿って歩き、それから橋の下に座って、春に先生がくれた本について話しました。" * 4,
        "ko": "어제 우리는 비가 내리기 시작할 때까지 강을 따라 걸었고, 그 다음에는 다리 밑에 앉아서 봄에 선생님이 주신 책에 대해 이야기했습니다. " * 3,
        "zh": "昨天我们沿着河边散步，直到开始下雨，然后我们坐在桥下，谈论春天老师给我们的书。" * 5,
    }
    assert {k: text.language_of(v) for k, v in texts.items()} == {k: k for k in texts}
    assert text.language_of("1234 5678 " * 20) is None and text.language_of(texts["en"][:149]) is None


def test_signatures(spark):
    from driftline.functions import signatures

    rows = [(None, None), (b"", None), (b"plain text", None), (b"\xff\xd8\xff", "image/jpeg"), (b"\xff\xfb\x90", "audio/mpeg"), (b"\xff\xd8", None), (b"GIF87a", "image/gif"), (b"PK\x03\x04" + b"-" * 5000 + b"word/", "application/zip"), (b"PK\x03\x04 xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), (b"0123ftypzzzz", "video/mp4"), (b"\x00\x01\x00\x00\x00", "font/ttf"), (b"\x00\x00\x01\xba", "video/mpeg"), (b"a" * 257 + b"ustar", "application/x-tar")]
    df = spark.createDataFrame([(n, b) for n, (b, _) in enumerate(rows)], "n int, b binary")
    assert [r.m for r in df.select("n", signatures.detected_type(F.col("b")).alias("m")).orderBy("n").collect()] == [m for _, m in rows]
    for digits, mime in signatures.SIGNATURES:  # none is hidden by a shorter one
        assert not [d for d, m in signatures.SIGNATURES if m != mime and len(d) >= len(digits) and d.startswith(digits)] or len(digits) < 16


def test_portal_pages():
    from driftline.functions import portal

    at = "https://web.archive.org/web/20200102030405id_/https://p/gemini/h/dir/page"
    assert portal.content(None, None)[5] == portal.content(at, "")[5] == portal.content(at, "<table><td>1<td>xx<td>2<td>m</table>")[5] == "no response line"
    assert portal.content(at, "<table><td>s<td> 20 OK<td>m<td>text/gemini</table>")[5] == "no body" and portal.content(at + "?crt=1", "<pre>x</pre>")[5] == "no certificate"
    assert portal.content(at, "<table><td>s<td> <td>m<td></table>") == (None, None, None, None, [], None)
    assert portal.content(at, "<table><td>s<td>20<td>m<td>text/plain; charset=latin-1</table><div class=body><pre>\u00e9 &amp; x")[2] == b"\xe9 & x"
    assert portal.content(at, "<table><td>s<td>20<td>m<td>image/png</table><div class=body><img src='data:image/png,x'>")[5] == "no body"
    for target, want in (("/web/20200102030405/https://p/gemini/h/a%20b", "/a b"), ("/web/20200102030405/https://p/gemini/o/a", "gemini://o/a"), ("/web/20200102030405/https://x.org/y?z", "https://x.org/y?z"), ("/gemini/o/z", "gemini://o/z"), ("https://x.org/", "https://x.org/"), ("mailto:a", "mailto:a")):
        assert portal.link_of(at, target)[0] == want
    page = portal.tree("<div class='x body'><p>one<p>two<ul><li>a<li>b</ul></div>text</b><div class=body><pre>z")
    assert [n.text() for n in page.all("p")] == ["one", "two"] and [n.text() for n in page.all("li")] == ["a", "b"] and page.first(("div", "body"), ("pre", None)).text() == "z" and page.first(("div", "y")) is None


def test_pictographic_ranges():
    import re
    import sys

    import regex

    mine, known = re.compile(f"[{text.PICTOGRAPHIC}]"), regex.compile(r"\p{Extended_Pictographic}")
    own, theirs = ({c for c in range(0x20, sys.maxunicode) if p.match(chr(c))} for p in (mine, known))
    # later versions of Unicode took some characters out that never were shown as emoji
    assert theirs <= own and len(own) < 1.3 * len(theirs)


def test_line_changes_are_few():
    rnd = random.Random(5)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    for _ in range(600):
        kinds = rnd.choice(["a", "ab", "abc", "abcdefgh"])
        a, b = ([rnd.choice(kinds) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        if rnd.random() < 0.5:
            b = [x for x in a if rnd.random() < 0.8] + b[:3]
        found = text.common_lines(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        changes = text.line_changes("\n".join(a), "\n".join(b))
        assert [x for _, c, x in changes if c != "Inserted"] == "\n".join(a).split("\n") and [(p, x) for p, c, x in changes if c != "Deleted"] == list(enumerate("\n".join(b).split("\n"), 1))
    big = [str(n % 50) for n in range(20000)]
    assert len(text.common_lines(big, [*big[:9000], "x", *big[9100:]])) == 19900
    assert text.common_lines([str(n) for n in range(30000)], [f"x{n}" for n in range(30000)]) == []
