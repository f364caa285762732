"""Robots files as rows: a table function that reads a file's lines once, joined to the files laterally."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is said about lines that give no rule, by kind.
WARNINGS = {
    "no_colon": "no directive, as there is no ':'",
    "no_agent": "Disallow without a User-agent before it is left out",
    "wildcard": "a wildcard within a path isn't supported, so the rule is left out",
    "allow": "Allow isn't supported",
    "crawl-delay": "Crawl-delay isn't supported",
    "sitemap": "Sitemap isn't supported",
    "unknown": "unknown directive",
}


def robots_lines(content: str | None) -> Iterator[tuple[int, str, str | None, str | None, str | None]]:
    """(line number, what, user agent, path, line) of the rules and warnings of a file, in order; ``what`` is ``rule`` or a
    kind of WARNINGS. User-agent lines share the rules below them until one follows a rule. A ``*`` that ends a path is
    cut, and a path without a ``/`` gets it; an empty path denies nothing."""
    agents: list[str] = []
    open_ = False
    for number, line in enumerate((content or "").split("\n"), 1):
        said = line.split("#", 1)[0].strip()
        name, colon, value = said.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not said:
            continue
        if not colon:
            yield number, "no_colon", None, None, line
        elif name == "user-agent":
            agents = [*agents, value.lower()] if open_ else [value.lower()]
            open_ = True
        elif name == "disallow":
            open_ = False
            path = value.removesuffix("*")
            if not agents or "*" in path:
                yield number, "wildcard" if agents else "no_agent", None, None, line
                continue
            path = path if not path or path.startswith("/") else f"/{path}"
            for agent in agents:
                yield number, "rule", agent, path, line
        else:
            yield number, name if name in WARNINGS and name not in ("no_colon", "no_agent") else "unknown", None, None, line


@F.udtf(returnType="line_number int, what string, user_agent string, path string, line string", useArrow=True)
class RobotsLines:
    def eval(self, content: str):
        yield from robots_lines(content)


def robots_rows(files: DataFrame) -> DataFrame:
    """The rules and warnings of ``files`` (authority, content)."""
    return files.select("authority", "content").lateralJoin(RobotsLines(F.col("content").outer())).drop("content")


def robots_warnings(files: DataFrame) -> DataFrame:
    """authority, line_number, kind and message of each line that gives no rule where one is meant."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair]), F.col("what"))
    return robots_rows(files).where("what <> 'rule'").select("authority", "line_number", F.col("what").alias("kind"), F.concat(F.lit("Line "), "line_number", F.lit(": "), kind).alias("message"))
