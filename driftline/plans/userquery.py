"""Search strings: scopes, then a boolean expression over phrases.

Scopes are taken out in the order intitle (bare word, then quoted), site, filetype, inurl; their values are in lower
case. What is left is words, "phrases", parentheses, and AND, OR, NOT in capitals before a space, parenthesis or
quote. Terms side by side belong together and bind closest, then NOT, AND, OR. An operator without its operands is a
word like any other, an open quote ends with the string, and parentheses that don't match are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.text import TERM

_SCOPES = (("title", r'\bintitle:([^\s"]+)'), ("title", r'\bintitle:"([^"]*)"'), ("site", r"\bsite:(\S+)"), ("filetype", r"\bfiletype:(\S+)"), ("url", r"\binurl:(\S+)"))
_TOKEN = re.compile(r'\s*(?:(\()|(\))|"([^"]*)(?:"|$)|((?:AND|OR|NOT)(?=[\s("]))|([^\s()"]+))')


@dataclass(frozen=True)
class Phrase:
    """Words that stand side by side, in lower case."""

    words: tuple[str, ...]


@dataclass(frozen=True)
class Node:
    kind: str  # AND, OR, NOT (left without right)
    left: Node | Phrase
    right: Node | Phrase


Expression = Node | Phrase


@dataclass(frozen=True)
class UserQuery:
    raw: str
    terms: str = ""
    expression: Expression | None = None
    site: str | None = None
    filetype: str | None = None
    title: str | None = None
    url: str | None = None

    @property
    def has_scope(self) -> bool:
        return any((self.site, self.filetype, self.title, self.url))

    @property
    def is_simple(self) -> bool:
        return self.expression is not None and not self.has_scope

    @property
    def valid_for_text(self) -> bool:
        return self.expression is not None or self.has_scope

    @property
    def valid_for_images(self) -> bool:
        return not self.title and (self.expression is not None or any((self.site, self.filetype, self.url)))

    @property
    def phrases(self) -> tuple[Phrase, ...]:
        return tuple(_phrases(self.expression))


def _phrases(e: Expression | None):
    if isinstance(e, Phrase):
        yield e
    elif e is not None:
        yield from _phrases(e.left)
        yield from _phrases(e.right)


def phrase(text: str) -> Phrase | None:
    words = tuple(TERM.findall(text.lower()))
    return Phrase(words) if words else None


@dataclass
class _Reader:
    tokens: list[tuple[str, str]]
    at: int = 0
    depth: int = field(default=0)

    def peek(self) -> tuple[str, str] | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def takes(self, operator: str) -> bool:
        """An operator counts if an operand follows it."""
        if self.peek() != ("op", operator):
            return False
        after = self.tokens[self.at + 1] if self.at + 1 < len(self.tokens) else None
        return after is not None and after[0] in ("(", "phrase", "op")

    def chain(self, operator: str, inner) -> Expression | None:
        left = inner()
        while left is not None and self.takes(operator):
            self.at += 1
            right = inner()
            if right is None:
                break
            left = Node(operator, left, right)
        return left

    def any_of(self) -> Expression | None:
        return self.chain("OR", self.all_of)

    def all_of(self) -> Expression | None:
        return self.chain("AND", self.without)

    def without(self) -> Expression | None:
        return self.chain("NOT", self.side_by_side)

    def side_by_side(self) -> Expression | None:
        left = self.operand(first=True)
        while left is not None and (right := self.operand(first=False)) is not None:
            left = Node("AND", left, right)
        return left

    def operand(self, first: bool) -> Expression | None:
        token = self.peek()
        if token is None:
            return None
        kind, text = token
        if kind == "op" and (first or not self.takes(text)):
            self.at += 1
            return phrase(text) or self.operand(first)
        if kind == "phrase":
            self.at += 1
            return phrase(text) or self.operand(first)
        if kind == "(":
            self.at += 1
            self.depth += 1
            inner = self.any_of()
            if self.peek() == (")", ")"):
                self.at += 1
            self.depth -= 1
            return inner if inner is not None else self.operand(first)
        if kind == ")" and not self.depth:
            self.at += 1
            return self.operand(first)
        return None


def expression(terms: str) -> Expression | None:
    tokens = []
    for m in _TOKEN.finditer(terms):
        opened, closed, quoted, operator, word = m.groups()
        tokens.append(("(", "(") if opened else (")", ")") if closed else ("op", operator) if operator else ("phrase", quoted if quoted is not None else word))
    reader = _Reader([t for t in tokens if t[1] is not None])
    return reader.any_of()


def parse(raw: str) -> UserQuery:
    rest = re.sub(r"\s+", " ", raw).strip()
    scopes: dict[str, str] = {}
    for name, pattern in _SCOPES:
        if name not in scopes and (m := re.search(pattern, rest)):
            if m[1].strip():
                scopes[name] = m[1].strip().lower()
            rest = f"{rest[: m.start()]} {rest[m.end() :]}"
    terms = re.sub(r"\s+", " ", rest).strip()
    return UserQuery(raw=raw, terms=terms, expression=expression(terms), **scopes)


def suggestion(q: UserQuery) -> UserQuery | None:
    """The query's words joined by OR, within the same site; None where that is no other query."""
    words = [w for p in q.phrases for w in p.words]
    if len(words) < 2:
        return None
    site = f"site:{q.site} " if q.site else ""
    return parse(site + " OR ".join(words))


def within_site(q: str, site: str) -> str:
    return f"site:{site} {q}"


def is_site_name(name: str) -> bool:
    return "." in name and re.fullmatch(r"[a-zA-Z0-9][a-zA-Z0-9.-]*[a-zA-Z0-9]", name) is not None


def wants_encyclopedia(q: UserQuery, page: int = 1) -> bool:
    """Whether an outside encyclopedia would be asked: first page, plain query, two words at most."""
    return page == 1 and q.is_simple and len(q.terms.split()) <= 2


_KINDS = T.StructType()
for _name in ("valid_for_text", "valid_for_images", "is_simple", "wants_encyclopedia"):
    _KINDS = _KINDS.add(_name, T.BooleanType())
for _name in ("site", "filetype", "title", "url"):
    _KINDS = _KINDS.add(_name, T.StringType())
_KINDS = _KINDS.add("phrases", T.IntegerType())


@F.pandas_udf(_KINDS)
def kinds(raw: pd.Series) -> pd.DataFrame:
    """What many search strings ask for, a row each: whether text and image searches take them, whether they are simple, their
    scopes, and how many phrases they have. A null string asks for nothing."""
    found = [parse(x or "") for x in raw]
    rows = [(q.valid_for_text, q.valid_for_images, q.is_simple, wants_encyclopedia(q), q.site, q.filetype, q.title, q.url, len(q.phrases)) for q in found]
    return pd.DataFrame(rows, columns=_KINDS.names)


PAGE = 15


@dataclass(frozen=True)
class Page:
    number: int
    size: int = PAGE

    @property
    def offset(self) -> int:
        return (max(self.number, 1) - 1) * self.size

    def has_next(self, total: int) -> bool:
        return self.offset + self.size < total


def page_of(path: str) -> Page:
    m = re.search(r"/p:(\d+)/", path)
    return Page(max(int(m[1]), 1) if m else 1)
