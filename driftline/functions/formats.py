"""Values as reports show them, and small normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: how many bytes tell text from binaries.
SNIFFED = 1445


def human_size(n: Column) -> Column:
    """GB, MB, KB or bytes of 1024; two decimals unless whole."""

    def shown(unit: int, name: str) -> Column:
        x = n / F.lit(float(unit))
        whole = n % unit == 0
        return F.concat(F.when(whole, F.format_string("%.0f", x)).otherwise(F.format_string("%.2f", x)), F.lit(f" {name}"))

    return F.when(n >= 1 << 30, shown(1 << 30, "GB")).when(n >= 1 << 20, shown(1 << 20, "MB")).when(n >= 1 << 10, shown(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def shown_url(domain: Column, path: Column, limit: int = 80) -> Column:
    whole = F.array_join(F.filter(F.concat(F.array(domain), F.split(path, "/")), lambda s: s != ""), " › ")
    return F.when(F.length(whole) > limit, F.concat(F.substring(whole, 1, limit), F.lit("…"))).otherwise(whole)


def snippet_clean(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.translate(F.regexp_replace(text, "\n", " "), "\r#", "")), r"\s+", " ")


def lead(text: Column, most: int = 100) -> Column:
    """What a hit without terms shows: one character less than asked for, as text search counts from 0."""
    return F.substring(text, F.lit(1), F.least(F.lit(most), F.length(text)) - 1)


def one_line(text: Column) -> Column:
    return F.trim(F.translate(text, "\r\n", ""))


def fingerprint_hex(digest: Column) -> Column:
    """Hex digits in pairs, in upper case, with colons between."""
    return F.regexp_replace(F.upper(digest), "(..)(?!$)", "$1:")


def savings_percent(optimized: Column, unoptimized: Column) -> Column:
    return F.when(unoptimized > 0, (1 - optimized / unoptimized) * 100).otherwise(F.lit(0.0))


def is_text(body_hex: Column) -> Column:
    """From the first SNIFFED bytes in hex (upper case): a byte order mark, or none of the bytes that only binaries hold."""
    bom = body_hex.rlike("^(FEFF|FFFE|EFBBBF)")
    binary = body_hex.rlike("^(?:..)*?(?:0[0-8BEF]|1[0-9A]|1[C-F])")
    return bom | ~binary


def legacy_status(status: Column, meta: Column) -> tuple[Column, Column]:
    """Old crawl rows to (status, meta): 0 and failed connections count as 49, MIME parameters and blanks go."""
    aborted, failed = meta.startswith("Requestor aborting"), meta.rlike("(?i)^(connect|connection|unable to connect)")
    new = F.when((status == 0) | (status.between(20, 29) & failed), 49).otherwise(status)
    plain = F.trim(F.substring_index(meta, ";", 1))
    return new, F.when(new.between(20, 29) & aborted, F.lit("")).when(new.between(20, 29), plain).otherwise(F.trim(meta))


def wayback_time(url: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(url, r"/web/(\d{14})", 1), F.lit("yyyyMMddHHmmss"))


def wayback_source(url: Column) -> Column:
    return F.regexp_extract(url, r"/web/\d{14}[a-z_]*/(.*)$", 1)


def filename_shown(path: Column) -> Column:
    """The decoded file name, or a slash."""
    name = F.try_url_decode(F.element_at(F.split(path, "/"), -1))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("/")).otherwise(name)


def language_shown(code: Column) -> Column:
    """The name of a few languages; other codes as they are."""
    names = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish", "pl": "Polish", "ru": "Russian", "ja": "Japanese", "zh": "Chinese"}
    out = code
    for k, v in names.items():
        out = F.when(F.lower(code) == k, F.lit(v)).otherwise(out)
    return out


def link_label(title: Column, domain: Column, path: Column, link_text: Column) -> Column:
    """A page's title, else its place, and what the link to it says."""
    name = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.concat(domain, path))
    return F.when(F.coalesce(link_text, F.lit("")) != "", F.concat(name, F.lit(' ("'), link_text, F.lit('")'))).otherwise(name)


def was_truncated(status: Column, meta: Column, size: Column) -> Column:
    """A success whose meta says that the crawler gave up, or that has no body."""
    return (status.between(20, 29) & meta.startswith("Requestor aborting")) | (status.between(20, 29) & (F.coalesce(size, F.lit(0)) == 0))


def is_domain_name(name: Column) -> Column:
    return name.rlike(r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63}$")


def wayback_capture(timestamp: Column, url: Column) -> Column:
    """Where the archive holds the untouched body of a capture."""
    return F.concat(F.lit("https://web.archive.org/web/"), timestamp, F.lit("id_/"), url)


def wayback_wanted(url: Column, least: int = 79, before: str = "2023-01-01") -> Column:
    """Captures of a gemini proxy from before a day; shorter addresses are the proxy's own pages."""
    return (F.length(url) >= least) & wayback_source(url).contains("/gemini/") & (wayback_time(url) < F.lit(before).cast("timestamp"))


def proxied_url(source: Column) -> Column:
    """The gemini URL that a proxy page shows."""
    return F.concat(F.lit("gemini://"), F.regexp_extract(source, "/gemini/(.*)$", 1))


def gemtext_row(url: Column, label: Column) -> Column:
    return F.concat(F.lit("=> "), url, F.lit(" "), one_line(label))
