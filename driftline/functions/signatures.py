"""What a binary body is, by its first bytes: signatures by their first byte, then container formats by what is in them. All of it
is JVM expressions over the head of the body, read as one character per byte."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a body that are looked at.
HEAD = 4096

#: Signatures at the beginning, the longer first where one begins another.
SIGNATURES = [
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("424D", "image/bmp"),
    ("49492A00", "image/tiff"),
    ("4D4D002A", "image/tiff"),
    ("00000100", "image/vnd.microsoft.icon"),
    ("38425053", "image/vnd.adobe.photoshop"),
    ("0000000C6A5020200D0A870A", "image/jp2"),
    ("FF0A", "image/jxl"),
    ("255044462D", "application/pdf"),
    ("25215053", "application/postscript"),
    ("7B5C727466", "application/rtf"),
    ("1F8B", "application/gzip"),
    ("425A68", "application/x-bzip2"),
    ("FD377A585A00", "application/x-xz"),
    ("28B52FFD", "application/zstd"),
    ("04224D18", "application/x-lz4"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("526172211A07", "application/vnd.rar"),
    ("4D534346", "application/vnd.ms-cab-compressed"),
    ("213C617263683E", "application/x-archive"),
    ("7F454C46", "application/x-elf"),
    ("4D5A", "application/x-msdownload"),
    ("CAFEBABE", "application/java-vm"),
    ("CFFAEDFE", "application/x-mach-binary"),
    ("CEFAEDFE", "application/x-mach-binary"),
    ("0061736D", "application/wasm"),
    ("53514C69746520666F726D6174203300", "application/vnd.sqlite3"),
    ("494433", "audio/mpeg"),
    ("FFFB", "audio/mpeg"),
    ("664C6143", "audio/flac"),
    ("4D546864", "audio/midi"),
    ("2321414D52", "audio/amr"),
    ("000001BA", "video/mpeg"),
    ("000001B3", "video/mpeg"),
    ("464C5601", "video/x-flv"),
    ("3026B2758E66CF11", "video/x-ms-asf"),
    ("774F4646", "font/woff"),
    ("774F4632", "font/woff2"),
    ("4F54544F", "font/otf"),
    ("0001000000", "font/ttf"),
    ("504152", "application/vnd.apache.parquet"),
    ("D4C3B2A1", "application/vnd.tcpdump.pcap"),
]
#: Containers (signature, where it stands, the type of the container, what its parts say, in order).
CONTAINERS = [
    ("504B0304", 0, "application/zip", [
        ("mimetypeapplication/epub+zip", "application/epub+zip"), ("mimetypeapplication/vnd.oasis.opendocument.text", "application/vnd.oasis.opendocument.text"),
        ("mimetypeapplication/vnd.oasis.opendocument.spreadsheet", "application/vnd.oasis.opendocument.spreadsheet"), ("word/", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
        ("xl/", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"), ("ppt/", "application/vnd.openxmlformats-officedocument.presentationml.presentation"), ("AndroidManifest.xml", "application/vnd.android.package-archive"),
        ("META-INF/MANIFEST.MF", "application/java-archive"),
    ]),
    ("D0CF11E0A1B11AE1", 0, "application/x-ole-storage", [
        ("W\0o\0r\0d\0D\0o\0c\0u\0m\0e\0n\0t", "application/msword"), ("W\0o\0r\0k\0b\0o\0o\0k", "application/vnd.ms-excel"), ("P\0o\0w\0e\0r\0P\0o\0i\0n\0t", "application/vnd.ms-powerpoint"),
    ]),
    ("66747970", 4, "video/mp4", [
        ("ftypM4A", "audio/mp4"), ("ftypqt", "video/quicktime"), ("ftyphei", "image/heic"), ("ftypmif1", "image/heic"), ("ftypavif", "image/avif"), ("ftyp3gp", "video/3gpp"),
    ]),
    ("52494646", 0, "application/x-riff", [("WAVEfmt", "audio/wav"), ("AVI LIST", "video/x-msvideo"), ("WEBPVP8", "image/webp")]),
    ("1A45DFA3", 0, "video/x-matroska", [("webm", "video/webm")]),
    ("4F676753", 0, "application/ogg", [("OpusHead", "audio/ogg"), ("\x01vorbis", "audio/ogg"), ("\x7fFLAC", "audio/ogg"), ("\x80theora", "video/ogg")]),
    ("7573746172", 257, "application/x-tar", []),
]


def _said(digits: str) -> str:
    return bytes.fromhex(digits).decode("latin-1")


def _case(branches: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda c, b: c.when(*b), branches[1:], F.when(*branches[0]))


def detected_type(body: Column) -> Column:
    """The MIME type that the body's first bytes show; null where none is known, and for empty and null bodies."""
    head = F.decode(F.substring(body, 1, HEAD), "ISO-8859-1")
    # the head is decoded once, whatever is compared with it
    return F.transform(F.array(head), _type_of)[0]


def _type_of(head: Column) -> Column:
    # first by the first byte, so that a body is compared with the few signatures that begin with its own
    by_byte: dict[str, list[tuple[str, str]]] = {}
    for digits, mime in sorted(SIGNATURES, key=lambda s: -len(s[0])):
        by_byte.setdefault(digits[:2], []).append((_said(digits), mime))
    plain = _case([(head.startswith(_said(byte)), _case([(head.startswith(s), F.lit(m)) for s, m in own])) for byte, own in sorted(by_byte.items())])
    containers = []
    for digits, at, mime, parts in CONTAINERS:
        here = F.substring(head, at + 1, len(digits) // 2) == _said(digits)
        inside = _case([(head.contains(word), F.lit(m)) for word, m in parts]).otherwise(F.lit(mime)) if parts else F.lit(mime)
        containers.append((here, inside))
    return F.coalesce(_case(containers), plain)
