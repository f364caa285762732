"""Parsers of responses: what a body is, links made absolute, HTML as gemtext, archive links, reports."""

from __future__ import annotations

import html.parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import formats, gemtext
from .robots import WARNINGS, robots_rows
from .text import image_header

#: Kinds of content.
UNKNOWN, GEMTEXT, IMAGE, BINARY, PLAIN = range(5)


def content_type(status: Column, mime: Column, body_hex: Column, image_type: Column) -> Column:
    """Redirects and failures are plain, then images by their header, binaries, gemtext and plain text by MIME type."""
    ok, text = status.between(20, 29) & (body_hex != ""), formats.is_text(body_hex)
    return F.when(~ok, PLAIN).when(image_type.isNotNull(), IMAGE).when(~text, BINARY).when(mime.startswith("text/gemini"), GEMTEXT).when(mime == "text/plain", PLAIN).otherwise(UNKNOWN)


def parsed(responses: DataFrame) -> DataFrame:
    """``responses`` (url, status_code, meta, mime_type, body) with content_type, title, indexable text, language-free
    links, feed flag and image header."""
    body = F.coalesce("body", F.lit(b""))
    sniffed = F.hex(F.substring(body, 1, formats.SNIFFED))
    df = responses.withColumn("image", F.when(F.col("status_code").between(20, 29), image_header(body)))
    df = df.withColumn("content_type", content_type(F.col("status_code"), F.coalesce("mime_type", F.lit("")), sniffed, F.col("image.image_type")))
    text = F.when(F.col("content_type").isin(GEMTEXT, PLAIN) & F.col("status_code").between(20, 29), F.decode(body, "UTF-8"))
    lines = gemtext.lines(text)
    gem = F.col("content_type") == GEMTEXT
    redirect = F.array(F.struct(F.col("meta").alias("target"), F.lit("").alias("link_text")))
    df = df.withColumn("links", F.when(F.col("status_code").between(30, 39), redirect).when(gem, gemtext.links(lines)).otherwise(F.array().cast("array<struct<target:string,link_text:string>>")))
    indexable = F.when(gem, gemtext.indexable(lines)).when((F.col("content_type") == PLAIN) & ~_special(F.col("url")), text)
    return df.withColumn("title", F.when(gem, gemtext.title(lines))).withColumn("indexable", indexable).withColumn("line_count", F.size(lines)).withColumn("is_feed", gem & gemtext.is_feed(F.col("links")))


def _special(url: Column) -> Column:
    from .urls import is_special

    return is_special(url)


def found_links(responses: DataFrame) -> DataFrame:
    """source url, target url, whether it leaves the site, link text; links that don't resolve are left out."""
    from .urls import authority, resolve

    each = parsed(responses).select("url", F.explode("links").alias("l")).withColumn("target", resolve(F.col("url"), F.col("l.target")))
    each = each.where(F.col("target").startswith("gemini://"))
    return each.select("url", "target", (authority(F.col("url")) != authority(F.col("target"))).alias("is_external"), F.col("l.link_text").alias("link_text"))


class _Reverser(html.parser.HTMLParser):
    """HTML to gemtext: headings, lists, quotes, preformatted text, and links on lines of their own."""

    def __init__(self):
        super().__init__()
        self.lines: list[str] = []
        self.now, self.links, self.start, self.skip, self.pre = "", [], "", 0, False
        self.href: str | None = None
        self.link_text = ""

    def flush(self):
        line = " ".join(self.now.split())
        if line or self.links:
            # a line that is one link becomes a link line
            if len(self.links) == 1 and line == " ".join(self.links[0][1].split()):
                self.lines.append(f"=> {self.links[0][0]} {line}".rstrip())
            else:
                if line:
                    self.lines.append(self.start + line)
                self.lines += [f"=> {h} {' '.join(t.split())}".rstrip() for h, t in self.links]
        self.now, self.links, self.start = "", [], ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif tag == "pre":
            self.flush()
            self.pre = True
            self.lines.append("```")
        elif tag == "hr":
            self.flush()
            self.lines.append("-" * 5)
        elif tag in ("p", "div", "figure", "figcaption", "br", "ul", "ol", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "section", "article"):
            self.flush()
            self.start = {"li": "* ", "blockquote": "> "}.get(tag, "#" * min(int(tag[1]), 3) + " " if tag[0] == "h" and tag[1:].isdigit() else self.start)
        elif tag == "a":
            self.href, self.link_text = dict(attrs).get("href"), ""
        elif tag == "img" and dict(attrs).get("src"):
            self.links.append((dict(attrs)["src"], dict(attrs).get("alt") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag == "pre" and self.pre:
            self.pre = False
            self.lines.append("```")
        elif tag == "a":
            if self.href:
                self.links.append((self.href, self.link_text))
            self.href = None
        elif tag in ("p", "div", "figure", "figcaption", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "tr"):
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        if self.pre:
            self.lines += data.strip("\n").split("\n")
            return
        self.now += data
        if self.href is not None:
            self.link_text += data


def reversed_html(text: str | None) -> str | None:
    if text is None:
        return None
    r = _Reverser()
    r.feed(text)
    r.close()
    r.flush()
    return "\n".join(r.lines)


@F.pandas_udf(T.StringType())
def html_to_gemtext(text: pd.Series) -> pd.Series:
    return text.map(reversed_html)


def archive_links(lines: Column, base: Column, ticks: Column) -> Column:
    """Link lines outside preformatted blocks pointed at the archive's copy, at the same time."""
    from .urls import resolve

    def pointed(line: Column) -> Column:
        target = F.regexp_extract(line, gemtext.LINK, 1)
        link = line.rlike(gemtext.LINK) & (~target.contains("://") | target.startswith("gemini://"))
        copy = F.concat(F.lit("=> /archive/cached?url="), F.url_encode(resolve(base, target)), F.lit("&t="), ticks.cast("string"), F.lit(" "), F.regexp_extract(line, gemtext.LINK, 2))
        return F.coalesce(F.when(link, copy), line)

    return gemtext.changed_outside_fences(lines, pointed)


def html_links(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def html_title(html: Column) -> Column:
    """The page's title as it is written; empty if there is none."""
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def robots_report(responses: DataFrame) -> DataFrame:
    """What is right and wrong with a site's robots file: status, type, body, its rules by user agent (those that deny
    nothing too), and its warnings in order of lines."""
    rows = robots_rows(responses.select("authority", "content"))
    message = F.element_at(F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair]), F.col("what"))
    said = F.when(F.col("what") != "rule", F.struct("line_number", F.col("what").alias("kind"), message.alias("message")))
    rule = F.when(F.col("what") == "rule", F.struct("user_agent", "line_number", "path"))
    found = rows.groupBy("authority").agg(F.sort_array(F.collect_list(said)).alias("warnings"), F.sort_array(F.collect_list(rule)).alias("rules"))
    df = responses.join(found, "authority", "left")
    found_ok, plain, body = F.col("status_code") == 20, F.substring_index("meta", ";", 1) == "text/plain", F.coalesce("content", F.lit("")) != ""
    empty = [F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("warnings", "rules")]
    return df.select("authority", found_ok.alias("found"), plain.alias("is_plain_text"), body.alias("has_body"), *empty, (found_ok & plain & F.coalesce(F.size("rules") > 0, F.lit(False))).alias("valid"))


def url_report(responses: DataFrame) -> DataFrame:
    return responses.select("url", (F.col("status_code") != 49).alias("connected"), "status_code", "meta", formats.human_size(F.octet_length("body").cast("bigint")).alias("size"))
