"""Pages of a web portal to gemini, as a web archive keeps them, back to what the portal was given: response line, body and
certificate. The page's HTML becomes a small tree, asked by element and class; its gemtext is made again tag by tag."""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import formats

#: Elements without an end, and those that end where another of them begins.
_EMPTY = {"br", "hr", "img", "meta", "link", "input"}
_ENDED_BY = {"li": {"li"}, "td": {"td", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "p": {"p", "h1", "h2", "h3", "ul", "pre", "blockquote", "hr", "div", "figure"}}
_CAPTURE = re.compile(r"/web/\d{14}[a-z_]*/(.*)", re.S)
_CERTIFICATE = "-----BEGIN CERTIFICATE-----"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        out, left = [], [self]
        while left:
            node = left.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                left += reversed(node.children)
        return "".join(out)

    def all(self, tag: str, class_: str | None = None) -> list[Node]:
        """The elements below, in order of the page."""
        out, left = [], [c for c in reversed(self.children) if isinstance(c, Node)]
        while left:
            node = left.pop()
            if node.tag == tag and (class_ is None or class_ in node.attrs.get("class", "").split()):
                out.append(node)
            left += [c for c in reversed(node.children) if isinstance(c, Node)]
        return out

    def first(self, *steps: tuple[str, str | None]) -> Node | None:
        """The first element that stands below one of each step, as ``div.body pre``."""
        if not steps:
            return self
        return next((found for node in self.all(*steps[0]) if (found := node.first(*steps[1:]))), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while self.open[-1].tag in _ENDED_BY and tag in _ENDED_BY[self.open[-1].tag]:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _EMPTY:
            self.open.append(node)

    def handle_endtag(self, tag):
        for n in range(len(self.open) - 1, 0, -1):
            if self.open[n].tag == tag:
                del self.open[n:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def shown_url(source: str) -> str | None:
    """The gemini URL that a portal page shows; None for other pages."""
    path = urlsplit(source).path
    return f"gemini://{unquote(path[len('/gemini/') :])}" if path.startswith("/gemini/") else None


def link_of(page: str, target: str) -> tuple[str, str | None]:
    """What a link of an archived portal page meant, by path where it's to the same capsule; and the capture that it leads to, if that is
    a portal page."""
    whole = urljoin(page, target)
    found = _CAPTURE.search(urlsplit(whole)._replace(scheme="", netloc="").geturl()) if urlsplit(whole).netloc == urlsplit(page).netloc else None
    # some pages have the portal's paths on the archive's host
    source = found[1] if found else whole
    shown = shown_url(source)
    if shown is None:
        return source, None
    own = shown_url((_CAPTURE.search(page) or [page, page])[1]) or ""
    same = urlsplit(shown).netloc == urlsplit(own).netloc
    return (urlsplit(shown)._replace(scheme="", netloc="").geturl() or "/") if same else shown, whole if found else None


def gemtext(page: str, root: Node) -> tuple[str, list[str]]:
    """The gemtext that the portal made ``root`` of, and captures of images within."""
    out: list[str] = []
    more: list[str] = []
    for node in root.children:
        if isinstance(node, str):
            continue
        if node.tag in ("h1", "h2", "h3"):
            out.append(f"{'#' * int(node.tag[1])} {node.text()}\n")
        elif node.tag == "a":
            out.append(f"=> {link_of(page, node.attrs.get('href', ''))[0]} {node.text()}")
        elif node.tag == "br":
            out.append("\n")
        elif node.tag == "hr":
            out.append("---\n")
        elif node.tag == "li":
            out.append(f"* {node.text()}\n")
        elif node.tag == "p":
            out.append(node.text())
        elif node.tag == "pre":
            out.append(f"```\n{node.text()}\n```\n")
        elif node.tag == "blockquote":
            out += [f"> {line}\n" for line in node.text().split("\n")]
        elif node.tag == "figure" and (img := node.first(("img", None))):
            link, capture = link_of(page, img.attrs.get("src", ""))
            more += [capture] if capture else []
            out.append(f"=> {link} {img.attrs.get('alt', '')}\n")
        elif node.tag == "ul":
            text, inner = gemtext(page, node)
            out.append(text)
            more += inner
    return "".join(out), more


def content(page: str | None, html: str | None) -> tuple[int | None, str | None, bytes | None, bytes | None, list[str], str | None]:
    """(status, meta, body, certificate, captures to look at, what is wrong) of an archived portal page."""
    root, nothing = tree(html or ""), (None, None, None, None, [])
    source = (_CAPTURE.search(page or "") or ["", ""])[1]
    if urlsplit(source).query.startswith("crt="):
        pre = root.first(("pre", None))
        said = pre.text() if pre else ""
        if _CERTIFICATE not in said:
            return *nothing, "no certificate"
        digits = said[said.index(_CERTIFICATE) + len(_CERTIFICATE) :].split("-----")[0]
        try:
            return None, None, None, base64.b64decode(digits), [], None
        except binascii.Error:
            return *nothing, "no certificate"
    table = root.first(("table", None))
    cells = table.all("td") if table else []
    if len(cells) != 4:
        return *nothing, "no response line"
    status, meta = cells[1].text().strip()[:2], cells[3].text().strip()
    if not status.isdigit():
        return *nothing, None if not status else "no response line"
    if not status.startswith("2"):
        return int(status), meta, None, None, [], None
    mime, _, rest = meta.partition(";")
    charset = re.search(r"charset=([^;\s]+)", rest, re.I)
    kind, more, body, wrong = mime.strip().lower(), [], None, None
    if kind == "text/gemini" and (own := root.first(("div", "body"), ("div", "gemini"))):
        body, more = gemtext(page, own)
    elif kind == "text/plain" and (own := root.first(("div", "body"), ("pre", None))):
        body = own.text()
    elif kind in ("image/jpeg", "image/png") and (own := root.first(("div", "body"), ("img", None))) and own.attrs.get("src"):
        head, comma, data = own.attrs["src"].partition(",")
        if head.startswith("data:"):
            try:
                body = base64.b64decode(data) if ";base64" in head else None
            except binascii.Error:
                body = None
            wrong = None if body is not None else "no body"
        else:
            return None, None, None, None, [urljoin(page, own.attrs["src"])], None
    else:
        wrong = "no body"
    if isinstance(body, str):
        try:
            body = body.encode(charset[1] if charset else "utf-8", "replace")
        except LookupError:
            body = body.encode()
    return int(status), meta, body, None, more, wrong


_SHAPE = T.StructType().add("status_code", T.IntegerType()).add("meta", T.StringType()).add("body", T.BinaryType()).add("certificate", T.BinaryType()).add("more", T.ArrayType(T.StringType())).add("problem", T.StringType())


@F.pandas_udf(_SHAPE)
def _content(page: pd.Series, html: pd.Series) -> pd.DataFrame:
    rows = [content(p, h) for p, h in zip(page, html, strict=True)]
    return pd.DataFrame(rows, columns=_SHAPE.names).astype({"status_code": "Int32"})


def captures(pages: DataFrame) -> DataFrame:
    """What archived portal pages (capture, html) tell: url, received, status_code, meta, body, certificate (DER) and its SHA-256
    ``fingerprint``, further captures to look at, and a problem where the page isn't as it should be. A page with an empty status tells
    nothing; null pages have no response line."""
    found = pages.withColumn("c", _content("capture", "html")).select(*pages.columns, "c.*").drop("html")
    url = formats.proxied_url(F.regexp_replace(formats.wayback_source(F.col("capture")), r"\?.*$", ""))
    return found.withColumns({"url": F.try_url_decode(url), "received": formats.wayback_time(F.col("capture")), "fingerprint": F.sha2("certificate", 256)})
