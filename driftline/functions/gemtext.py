"""Gemtext as columns: lines, preformatted blocks, links, titles, feeds, tags. All of it is JVM expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The format's line forms, and the forms of dates, tags and names that documents are known by.
LINK = r"(?s)^=>\s*(\S+)\s*(.*)"
HEADING = r"^(#+)\s*([^\n]+)"
FENCE = "```"
DATE = r"^\d{4}\-[01]\d\-[0123]\d"
TAG = r"[\,\s]#([a-zA-Z0-9][a-zA-Z0-9_\-]+)"
NO_TAG = r"^([\d\-]+|[a-fA-F0-9]{3}|[a-fA-F0-9]{6})$"
NAME_WITHIN = r"[\s\,][\@\~]([a-zA-Z_][a-zA-Z\d_\-]{2,})\s"
NAME_FIRST = r"^[\@\~]([a-zA-Z_][a-zA-Z\d_\-]{2,})\s"


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r", ""), "\n")


#: A block between fences in a text that starts and ends with a line break; one that isn't closed takes the rest.
BLOCK = r"(?s)\n```[^\n]*(?=\n)(?:(?:(?!\n```).)*+\n```[^\n]*(?=\n)|.*(?=\n\z))"


def _framed(lines_: Column) -> Column:
    return F.concat(F.lit("\n"), F.array_join(lines_, "\n", ""), F.lit("\n"))


def _unframed(text: Column) -> Column:
    return F.when(F.length(text) > 1, F.split(F.substring(text, F.lit(2), F.length(text) - 2), "\n")).otherwise(F.array().cast("array<string>"))


def outside_fences(lines_: Column) -> Column:
    """The lines outside preformatted blocks; a block that isn't closed takes the rest."""
    # joined and split again, so that the work follows the text's length: a block runs from a fence to the next one
    return _unframed(F.regexp_replace(_framed(lines_), BLOCK, ""))


def changed_outside_fences(lines_: Column, change: Callable[[Column], Column]) -> Column:
    """The lines with ``change`` made to those outside preformatted blocks; the work follows the text's length."""
    parts = F.split(_framed(lines_), BLOCK, -1)
    blocks = F.concat(F.regexp_extract_all(_framed(lines_), F.lit(BLOCK), F.lit(0)), F.array(F.lit("")))
    # a part is empty or starts with a break; the last one ends with one
    made = F.transform(parts, lambda p: F.array_join(F.transform(F.split(p, "\n", -1), lambda x: F.when(x == "", x).otherwise(change(x))), "\n"))
    return _unframed(F.array_join(F.zip_with(made, blocks, lambda p, b: F.concat(p, b)), ""))


def links(lines_: Column) -> Column:
    """array<struct<target, link_text>> of link lines; other schemes than gemini are left out."""
    found = F.filter(lines_, lambda x: x.rlike(LINK))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, LINK, 1).alias("target"), F.trim(F.regexp_extract(x, LINK, 2)).alias("link_text")))
    return F.filter(pairs, lambda p: ~p["target"].contains("://") | p["target"].startswith("gemini://"))


def title(lines_: Column) -> Column:
    """The first heading with text, of any level, over all lines; else what stands beside the first fence."""
    heads = F.filter(F.transform(lines_, lambda x: F.trim(F.regexp_extract(x, HEADING, 2))), lambda t: t != "")
    fence = F.filter(lines_, lambda x: x.startswith(FENCE))
    alt = F.when(F.size(fence) > 0, F.nullif(F.trim(F.substring(fence[0], 4, 1 << 30)), F.lit("")))
    return F.when(F.size(heads) > 0, heads[0]).otherwise(alt)


def indexable(lines_: Column) -> Column:
    """Text for the index: no preformatted blocks, of link lines only their text, each line ended."""
    kept = F.transform(outside_fences(lines_), lambda x: F.when(x.rlike(LINK), F.regexp_extract(x, LINK, 2)).otherwise(x))
    kept = F.filter(kept, lambda x: x != "")
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise(F.lit(""))


def is_feed(links_: Column) -> Column:
    """At least two links whose text, of ten characters or more, starts with a date."""
    return F.size(F.filter(links_, lambda p: p["link_text"].rlike(DATE))) >= 2


def _said(line: Column) -> Column:
    """Where a line may hold tags and names: a link line's text, a heading's text, else all of it."""
    return F.when(line.startswith("=>"), F.regexp_extract(line, LINK, 2)).when(line.rlike(HEADING), F.regexp_extract(line, HEADING, 2)).otherwise(line)


def _lower_set(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.flatten(found), lambda t: F.lower(t))))


def hashtags(lines_: Column) -> Column:
    """Distinct tags of lines (outside preformatted blocks) in lower case, without numbers, their ranges and colours."""
    found = F.transform(lines_, lambda x: F.filter(F.regexp_extract_all(_said(x), F.lit(TAG), F.lit(1)), lambda t: ~t.rlike(NO_TAG)))
    return _lower_set(found)


def mentions(lines_: Column) -> Column:
    """Distinct names of lines after @ or ~, of three characters or more, in lower case."""

    def names(line: Column) -> Column:
        said = F.concat(_said(line), F.lit(" "))
        return F.concat(F.regexp_extract_all(said, F.lit(NAME_WITHIN), F.lit(1)), F.regexp_extract_all(said, F.lit(NAME_FIRST), F.lit(1)))

    return _lower_set(F.transform(lines_, names))
