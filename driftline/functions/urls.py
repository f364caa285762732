"""URL columns: parts, file extension, path words, special files. A URL's id is a hash of its normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORT = 1965
#: Paths of files that crawlers ask for unasked.
FAVICON, ROBOTS, SECURITY = "/favicon.txt", "/robots.txt", "/.well-known/security.txt"
_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]*)(?::(\d+))?([^?#]*)(\?[^#]*)?"
#: Image endings that path words leave out.
IMAGE_ENDINGS = r"(?i)\.(gif|jpg|jpeg|png|webp)$"


def protocol(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def port(url: Column, default: int = DEFAULT_PORT) -> Column:
    found = F.regexp_extract(url, _URL, 3)
    return F.when(found == "", F.lit(default)).otherwise(found.cast("int"))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, _URL, 4)
    return F.when(found == "", F.lit("/")).otherwise(found)


def query(url: Column) -> Column:
    return F.substring(F.regexp_extract(url, _URL, 5), 2, 1 << 30)


def filename(url: Column) -> Column:
    return F.element_at(F.split(path(url), "/"), -1)


def extension(url: Column) -> Column:
    """The file ending in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(filename(url), r"\.([^.]*)$", 1))


def authority(url: Column, default: int = DEFAULT_PORT) -> Column:
    return F.concat_ws(":", domain(url), port(url, default).cast("string"))


def normalized(url: Column, default: int = DEFAULT_PORT) -> Column:
    """Scheme and host in lower case, the default port left out, no fragment, at least a slash for a path."""
    shown = F.when(port(url, default) == default, F.lit("")).otherwise(F.concat(F.lit(":"), port(url, default).cast("string")))
    return F.concat(protocol(url), F.lit("://"), domain(url), shown, path(url), F.regexp_extract(url, _URL, 5))


def _without_dots(path_: Column) -> Column:
    """The path without . and .. segments, as RFC 3986 removes them; it starts with a slash."""

    def step(acc: Column, segment: Column) -> Column:
        return F.when(segment == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(segment == ".", acc).otherwise(F.concat(acc, F.array(segment)))

    kept = F.aggregate(F.split(F.substring(path_, 2, 1 << 30), "/"), F.array(F.lit("")), step)
    ends_in_dots = path_.rlike(r"/\.{1,2}$")
    dotted = F.concat(F.array_join(kept, "/"), F.when(ends_in_dots, "/").otherwise(""))
    return F.when(path_.rlike(r"/\.{1,2}(/|$)"), F.when(dotted == "", "/").otherwise(dotted)).otherwise(path_)


def resolve(base: Column, target: Column) -> Column:
    """The absolute URL of a link by RFC 3986, whatever the scheme; null where it has a scheme but no host, or either is null.
    A target that names another host keeps its path as it is."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    own, query_ = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    said, tail = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(own, "[^/]*$", "")
    merged = F.when(said.startswith("/"), said).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), said))
    relative = F.when(said != "", F.concat(site, _without_dots(merged), tail)).when(tail.startswith("?"), F.concat(site, own, tail)).otherwise(F.concat(site, own, query_, tail))
    named = target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:")
    return F.when(named, F.when(target.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]"), target)).when(target.startswith("//"), F.when(target.rlike("^//[^/?#]"), F.concat(scheme, F.lit(":"), target))).otherwise(F.when(site != "", relative))


def url_id(url: Column, default: int = DEFAULT_PORT) -> Column:
    return F.xxhash64(normalized(url, default))


def is_special(url: Column) -> Column:
    """Files that crawlers ask for without a link: favicon, robots, security contact."""
    return path(url).isin(FAVICON, ROBOTS, SECURITY)


def is_site_name(name: Column) -> Column:
    """Whether a text may be a capsule's name: letters, digits, dots and hyphens, with a dot, neither end a dot or hyphen."""
    return F.coalesce(name.contains(".") & name.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9.\-]*[a-zA-Z0-9]$"), F.lit(False))


def path_words(path_: Column) -> Column:
    """Words of a path, last segment first: decoded, image endings dropped, cut at - _ . , and before capitals."""
    segments = F.reverse(F.filter(F.split(path_, "/"), lambda s: s != ""))
    plain = F.transform(segments, lambda s: F.regexp_replace(F.try_url_decode(s), IMAGE_ENDINGS, ""))
    pieces = F.flatten(F.transform(plain, lambda s: F.filter(F.split(s, "[-_.,]"), lambda w: w != "")))
    return F.flatten(F.transform(pieces, lambda w: F.regexp_extract_all(w, F.lit(r"\p{Lu}+(?![^\p{Lu}])|\p{Lu}?[^\p{Lu}]+|\p{Lu}+"), F.lit(0))))
