"""Secret scans with structural confirmation.

Base spans are pattern matches. Besides them, candidates in base64 or hex are decoded and reported only if what
comes out has the structure of a secret: a private key in DER (nested lengths have to add up), an OpenSSH private
key (length-prefixed fields), a PEM block around either, or a signed token whose header and claims are JSON. Base64 may
be broken into lines, by escaped breaks (\\n) too, and may hold a PEM block.

The work follows the text's length, whatever is in it: a footer belongs to the last header before it, lines of base64 are
cut once for all keys that may begin in them, and only the length fields of a candidate are decoded until they add up.

Offsets count code points, ends are exclusive. Null text counts as empty and has no spans; each row gives one row.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "openssh")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
#: A run of 16 or more; shorter runs would be dropped, and no match can begin within one.
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*){2,4}")
MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,64}?PRIVATE KEY)-----")
BODY = re.compile(r"[A-Za-z0-9+/=\s:,.\\-]*")
BLANK = re.compile(r"\n[^\S\n]*\n")
#: Line breaks as strings in code and JSON have them, escaped once or more.
ESCAPED = re.compile(r"(?<!\\)(?:(?:\\+r)?\\+n|\\+r)")
#: Where base64 of a key in DER, of an OpenSSH key or of a PEM block begins, and a line of it with the break before it.
BEGIN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{6,}")
LINE = re.compile(r"([A-Za-z0-9+/_-]+)(={0,2})")
BREAK = re.compile(r"[ \t\r]*\n[ \t]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"[0-9a-fA-F]{64,}")
OPENSSH = b"openssh-key-v1\0"
#: The outer sequence of a private key has fewer fields than this.
FIELDS = 16
#: Gives bytes from one place to another of what may be decoded piece by piece.
Reader = Callable[[int, int], bytes]


def _fields(read: Reader, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the fields that fill at to end exactly."""
    out: list[tuple[int, int, int]] = []
    while at < end:
        head = read(at, min(at + 6, end))
        if len(head) < 2 or len(out) == FIELDS:
            return None
        tag, size, at = head[0], head[1], at + 2
        if size & 128:
            n = size & 127
            if not 1 <= n <= 4 or 2 + n > len(head):
                return None
            size, at = int.from_bytes(head[2 : 2 + n], "big"), at + n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def _der_key(read: Reader, size: int) -> bool:
    outer = _fields(read, 0, size) if read(0, 1) == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _fields(read, *outer[0][1:])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _, _ in inner]
    small = inner[0][2] - inner[0][1] == 1 and read(inner[0][1], inner[0][2])[0] <= 1
    if tags[0] == 2 and small:
        if len(tags) >= 6 and all(t in (2, 0x30) for t in tags):
            return True
        if tags[1] == 4:
            return inner[1][2] - inner[1][1] >= 16
        if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 4:
            algorithm = _fields(read, *inner[1][1:])
            return bool(algorithm) and algorithm[0][0] == 6
    if tags == [0x30, 4]:
        algorithm = _fields(read, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 6 and inner[1][2] - inner[1][1] >= 16
    return False


def is_der_key(raw: bytes) -> bool:
    """A private key: PKCS#1, DSA, SEC 1, PKCS#8, or PKCS#8 encrypted."""
    return _der_key(lambda a, z: raw[a:z], len(raw))


def is_openssh_key(raw: bytes) -> bool:
    return _openssh_size(lambda a, z: raw[a:z], len(raw)) == len(raw)


def _openssh_size(read: Reader, size: int) -> int | None:
    """cipher, kdf, kdf options, number of keys, that many public keys, private part; each with its length."""
    if read(0, len(OPENSSH)) != OPENSSH:
        return None
    at = len(OPENSSH)

    def number() -> int | None:
        nonlocal at
        at += 4
        return int.from_bytes(read(at - 4, at), "big") if at <= size else None

    def field() -> bool:
        nonlocal at
        if (n := number()) is None or at + n > size:
            return False
        at += n
        return True

    if not all(field() for _ in range(3)) or (keys := number()) is None:
        return None
    return at if 1 <= keys <= 64 and all(field() for _ in range(keys + 1)) else None


def _unbase64(text: str) -> bytes | None:
    text = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


def _object(text: str) -> dict | None:
    raw = _unbase64(text)
    try:
        found = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(text: str) -> bool:
    """A signed token (header, claims, signature) or an encrypted one (five parts, enc in the header)."""
    parts = text.split(".")
    header = _object(parts[0])
    if not header or not isinstance(header.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(header.get("enc"), str)
    return len(parts) == 3 and _object(parts[1]) is not None and (bool(parts[2]) or header["alg"].lower() == "none")


def _key(raw: bytes | None) -> str | None:
    if not raw:
        return None
    return "der" if is_der_key(raw) else "openssh" if is_openssh_key(raw) else "pem" if _pem_blocks(raw.decode("latin-1")) else None


def _unescaped(text: str) -> str:
    """The text with escaped line breaks as real ones, each as long as before."""
    return ESCAPED.sub(lambda m: " " * (len(m[0]) - 1) + "\n", text) if "\\" in text else text


def _pem_blocks(text: str) -> list[tuple[int, int]]:
    """Blocks of a footer and the last header before it, if they are of a kind and a key stands between them."""
    blocks, begin = [], None
    for m in MARKER.finditer(text) if "PRIVATE KEY-----" in text else ():
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin and begin[2] == m[2] and BODY.fullmatch(text, begin.end(), m.start()):
            head, body = "", text[begin.end() : m.start()]
            if ":" in body:
                at = [b.end() for b in BLANK.finditer(body)] or [0]
                head, body = body[: at[-1]], body[at[-1] :]
            raw = _unbase64("".join(body.replace("\\", "").split()))
            if raw and (is_der_key(raw) or is_openssh_key(raw) or "ENCRYPTED" in head):
                blocks.append((begin.start(), m.end()))
        begin = None
    return blocks


def _der_size(raw: bytes) -> int | None:
    """Bytes that the outer sequence says it has, if what it begins with can begin a key."""
    n = raw[1] & 127 if raw[1] & 128 else 0
    if raw[:1] != b"\x30" or n > 4 or raw[1] == 128 or raw[2 + n : 3 + n] not in (b"\x02", b"\x30"):
        return None
    return 2 + n + (int.from_bytes(raw[2 : 2 + n], "big") if n else raw[1])


class _Lines:
    """A chain of base64 lines, each right after the break that ends the one before. ``before[i]`` characters stand in
    the lines before line i."""

    def __init__(self, text: str, at: int):
        self.starts, self.ends, lines = [], [], []
        while line := LINE.match(text, at):
            self.starts.append(at)
            self.ends.append(line.end())
            lines.append(line[1])
            gap = BREAK.match(text, line.end())
            if line[2] or not gap:
                break
            at = gap.end()
        self.said, self.before = "".join(lines), [0, *accumulate(map(len, lines))]
        #: places modulo 4 from which all that follows was searched for PEM blocks
        self.searched: set[int] = set()


def _wrapped(text: str) -> list[tuple[str, int, int]]:
    """Keys in base64 over several lines without armour. Their own lengths say where they end, which has to be the end
    of a line."""
    out: list[tuple[str, int, int]] = []
    chain_at: dict[int, tuple[_Lines, int]] = {}
    for m in BEGIN.finditer(text):
        if out and m.start() < out[-1][2]:
            continue
        wanted = None
        if m[0][0] == "M":
            size = _der_size(base64.b64decode(m[0][:8].replace("-", "+").replace("_", "/")))
            if not size:
                continue
            wanted = (4 * size + 2) // 3
        first = LINE.match(text, m.start())
        gap = BREAK.match(text, first.end())
        if first[2] or not gap:
            continue
        if gap.end() not in chain_at:
            made = _Lines(text, gap.end())
            chain_at |= {start: (made, i) for i, start in enumerate(made.starts) if start not in chain_at}
        if gap.end() not in chain_at:  # the next line isn't base64
            continue
        chain, i = chain_at[gap.end()]
        own, skipped = first[1], chain.before[i]
        have = len(own) + len(chain.said) - skipped

        def read(a: int, z: int, own: str = own, chain: _Lines = chain, skipped: int = skipped) -> bytes:
            """Bytes a to z of what own and the lines of the chain say."""
            x, y, n = a // 3 * 4, -(-z // 3) * 4, len(own)
            said = own[x:y] + chain.said[skipped + max(0, x - n) : skipped + max(0, y - n)]
            raw = _unbase64(said[: len(said) - (len(said) % 4 == 1)]) or b""
            return raw[a - x // 4 * 3 : z - x // 4 * 3]

        def end_of(chars: int, chain: _Lines = chain, i: int = i, n: int = len(own) - skipped) -> int | None:
            """Where the line ends that ends with so many characters, if one does."""
            at = bisect_left(chain.before, chars - n, i + 1)
            return chain.ends[at - 1] if at < len(chain.before) and chain.before[at] == chars - n else None

        if wanted:
            if (end := end_of(wanted)) and _der_key(read, wanted * 3 // 4):
                out.append(("der", m.start(), end))
        elif m[0].startswith("b3Bl"):
            if (size := _openssh_size(read, have * 3 // 4)) and (end := end_of((4 * size + 2) // 3)):
                out.append(("openssh", m.start(), end))
        elif (place := (skipped - len(own)) % 4) not in chain.searched:
            # what begins later at the same place modulo 4 is searched along
            chain.searched.add(place)
            if blocks := _pem_blocks(read(0, have * 3 // 4).decode("latin-1")):
                # to the end of the line with the last block's end
                at = next(k for k in range(i + 1, len(chain.before)) if (len(own) + chain.before[k] - skipped) * 3 // 4 >= blocks[-1][1])
                out.append(("pem", m.start(), chain.ends[at - 1]))
    return out


def _within(blocks: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span lies in one of the blocks."""
    blocks = sorted(blocks)
    starts, reach = [a for a, _ in blocks], list(accumulate((z for _, z in blocks), max))
    return lambda a, z: (n := bisect_right(starts, a)) > 0 and z <= reach[n - 1]


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans, by start, then kind as in KINDS."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "." in text:
        for m in JWT.finditer(text):
            # a full stop may follow the token
            if is_token(whole := m[0].rstrip(".")):
                out.append(("jwt", m.start(), m.start() + len(whole)))
    plain = _unescaped(text)
    blocks = _pem_blocks(plain)
    out += [("pem", *b) for b in blocks]
    known = _within(blocks)
    wrapped = [w for w in _wrapped(plain) if not known(*w[1:])]
    out += wrapped
    known = _within(blocks + [(a, z) for _, a, z in wrapped])
    for pattern, decode in ((BASE64, _unbase64), (ANY_HEX, lambda x: bytes.fromhex(x) if len(x) % 2 == 0 else None)):
        for m in pattern.finditer(plain):
            if known(*m.span()):
                continue
            raw = decode(m[0])
            if kind := _key(raw):
                out.append((kind, *m.span()))
            elif raw and raw[:1] == b"e" and raw.isascii() and is_token(raw.decode()):
                out.append(("jwt", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t)] for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _ARROW)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, start, end in find(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span replaced by ``mark`` and n_chars (if there) counted anew; null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new = [None if t is None else redacted(t, mark) for t in b.column("text").to_pylist()]
            cols = dict(zip(names, b.columns, strict=True)) | {"text": pa.array(new, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([o if t is None else len(t) for t, o in zip(new, cols["n_chars"].to_pylist(), strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
