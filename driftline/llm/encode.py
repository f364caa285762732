"""Exact token ids of public BPE vocabularies at corpus speed.

White space bounds every pre-token of both vocabularies used here, so a text's ids are those of its runs of
white space plus non-space characters, one after the other, and a run's ids can be kept. Runs not seen yet are
encoded by merge ranks where that provably gives the library's result, else by the library itself. Where pre-tokens
don't hold white space, simple texts (ASCII and letters) get a space between them first, and lower case, so fewer runs are new.

By merge ranks a run gets the ids that the library's merge list gives if every vocabulary entry encodes to
itself: two neighbours that could join into entry s are then always the two that s was made of, since what
happens within s doesn't depend on what stands around it. ``_sound`` tests that when an encoder is made.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Python takes these as white space, the library doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
RUN = re.compile(r"\s*\S+|\s+")
#: Characters in whose class and case all libraries agree: ASCII and precomposed Latin letters.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž]*")
LETTER, DIGIT = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ž", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^\\s{LETTER}{DIGIT}]+")
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Of these, white space, ASCII and letters.
SIMPLE = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž]*")
#: Longer texts are split at white space alone, so that no copies of them are made.
SPACED = 1 << 20
#: For each byte of such texts: 1 letter, 2 punctuation, 3 digit, 0 white space, and apostrophes, as contractions begin
#: with them. Where two neighbours give 3 together a pre-token ends.
KIND = bytes(1 if b >= 128 or chr(b).isalpha() else 3 if chr(b).isdigit() else 2 if 33 <= b != 39 else 0 for b in range(256))
END = "</w>"
#: Up to 128 bytes that words in lower case are written with, as codes below 128: a code with the high bit set ends a
#: word. Punctuation, a-z, and the UTF-8 bytes of Latin letters up to U+017E.
_SYMBOLS = [*range(33, 48), *range(58, 65), *range(91, 127), *range(0x80, 0xC0), *range(0xC2, 0xC6)]
CODED = [b in set(_SYMBOLS) for b in range(256)]
CODES = bytes(_SYMBOLS.index(b) if CODED[b] else 127 for b in range(256))
LAST = [bytes([CODES[b] | 128]) for b in range(256)]
#: Runs kept per generation; two generations are held. Longer runs than LONG aren't kept, so a worker holds 150 MB at most.
KEPT, LONG = 150_000, 64


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Runs(dict):
    """What a run gives, kept for two generations so that memory stays bounded while frequent runs stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, run: str):
        if len(run) > LONG:
            return self.make(run)
        value = self.old.get(run)
        if value is None:
            value = self.make(run)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[run] = value
        return value


class Encoder:
    """ids(), count() and cuts() of whole texts as ``Tokenizer.from_file(path)`` gives them without special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.vocab = spec["model"]["vocab"]
        self.words = spec["model"]["end_of_word_suffix"] == END
        self.marks = tuple(x["content"] for x in spec["added_tokens"])
        self.letters = _byte_letters()
        self.make = self._word_ids if self.words else self._byte_ids
        self.ranked = None
        ranks = self._word_ranks(spec) if self.words else self._byte_ranks()
        if ranks:
            self.ranked = tiktoken.Encoding("runs", pat_str=r"\S+" if self.words else BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            if not self._sound(ranks):
                self.ranked = None
        self.one = self.ranked and self.ranked._core_bpe.encode_single_piece
        if self.words:  # the merges alone; what stands before them in the library is done in _word_ids
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None})).model
        self.stops = {c: self.library.encode(c, add_special_tokens=False).ids for c in ".,;:!?"} if self.words else {}
        self.by_run = Runs(lambda run: array("I", self.make(run)).tobytes())
        self.n_by_run = Runs(lambda run: len(self.make(run)))

    def _bytes(self, entry: str) -> bytes:
        back = self.__dict__.setdefault("_from_letters", {c: b for b, c in self.letters.items()})
        return bytes(back[c] for c in entry)

    def _byte_ranks(self):
        marks = set(self.marks)
        return {self._bytes(x): i for x, i in self.vocab.items() if x not in marks}

    def _word_ranks(self, spec):
        """Entries that the symbols of ``CODES`` can write; a last byte has its high bit set if it ends a word."""
        order = {"".join(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        ranks, base = {}, None
        for entry, token in self.vocab.items():
            if entry in self.marks:
                continue
            ends = entry.endswith(END) and entry != END
            raw = self._bytes(entry[: -len(END)] if ends else entry)
            if not all(CODED[b] for b in raw):
                continue
            if len(raw) > 1:  # ids have to follow the order of merges, as ranks do
                base = token - order[entry] if base is None else base
                if token - order[entry] != base:
                    return None
            raw = raw.translate(CODES)
            ranks[raw[:-1] + bytes([raw[-1] | 128]) if ends else raw] = token
        spare = max(self.vocab.values()) + 1
        for b in range(256):
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = spare = spare + 1
        return ranks

    def _sound(self, ranks) -> bool:
        return all(self.ranked._core_bpe.encode_single_piece(raw) == [rank] for raw, rank in ranks.items())

    def _byte_ids(self, run: str) -> list[int]:
        if self.ranked and "<|" not in run and PLAIN.fullmatch(run):
            return self.ranked.encode_ordinary(run)
        return self.library.encode(run, add_special_tokens=False).ids

    def _word_ids(self, run: str) -> list[int]:
        if self.one and run.isascii() and run.isalpha():
            raw = run.lower().encode()
            return self.one(raw[:-1].translate(CODES) + LAST[raw[-1]])
        if "<|" in run or not run.isascii() and not PLAIN.fullmatch(run):
            return self.library.encode(run, add_special_tokens=False).ids
        low = run.lower()
        one = self.one
        if one and low.isalpha():
            raw = low.encode()
            return one(raw[:-1].translate(CODES) + LAST[raw[-1]])
        if one and low[-1:] in self.stops and low[:-1].isalpha():  # a word and a stop after it are words of their own
            raw = low[:-1].encode()
            return one(raw[:-1].translate(CODES) + LAST[raw[-1]]) + self.stops[low[-1]]
        out: list[int] = []
        for piece in WORD_PIECES.findall(low):
            raw = piece.encode()
            if one and all(map(CODED.__getitem__, raw)):
                out += one(raw[:-1].translate(CODES) + LAST[raw[-1]])
            else:
                out += [x.id for x in self.merges.tokenize("".join(map(self.letters.__getitem__, raw)))]
        return out

    def _spaced(self, text: str) -> str:
        """A simple text in lower case, with a space where a pre-token ends: its ids are the same, but a word is one run
        however it is written and whatever stands after it."""
        raw = text.lower().encode()
        kind = np.frombuffer(raw.translate(KIND), np.uint8)
        out = np.full((len(raw), 2), 32, np.uint8)
        out[:, 0] = np.frombuffer(raw, np.uint8)
        kept = np.ones((len(raw), 2), bool)
        np.equal(kind[:-1] | kind[1:], 3, out=kept[:-1, 1])
        return out[kept].tobytes().decode()

    def _runs(self, text: str) -> list[str] | None:
        """None: the library has to take the text as a whole."""
        if self.words and len(text) <= SPACED and "<|" not in text and SIMPLE.fullmatch(text):
            return self._spaced(text).split()
        if ODD_SPACE.search(text):
            return None
        return text.split() if self.words else RUN.findall(text)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        runs = self._runs(text)
        if runs is None:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.by_run.__getitem__, runs))

    def count(self, text: str) -> int:
        runs = self._runs(text)
        if runs is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.n_by_run.__getitem__, runs))

    def cuts(self, text: str) -> tuple[list[int], list[int], list[tuple[int, int] | None]]:
        """Places where a token starts, ascending, the tokens before each, and what proves a common place stable (see
        ``same``): None where a pre-token starts, else the token and the pre-token's end. The last place is the end."""
        runs = None if self.words else self._runs(text)
        at, n, places, before, marks = 0, 0, [], [], []
        for run in [text] if runs is None else runs:
            if runs is not None and len(run) <= LONG:
                places.append(at)
                before.append(n)
                marks.append(None)
                n += self.n_by_run[run]
            else:
                got = self.library.encode(run, add_special_tokens=False)
                word_ids, offsets, ids = got.word_ids, got.offsets, got.ids
                ends = {w: z for w, (_, z) in zip(word_ids, offsets, strict=True)}
                word, last = object(), -1
                for k, (mine, (start, end)) in enumerate(zip(word_ids, offsets, strict=True)):
                    # a character of several tokens has no place within
                    if mine != word or start == last:
                        places.append(at + start)
                        before.append(n + k)
                        marks.append(None if mine != word else (ids[k], at + ends[mine]))
                    word, last = mine, end
                n += len(ids)
            at += len(run)
        return [*places, at], [*before, n], [*marks, None]


def same(left: tuple[int, int] | None, right: tuple[int, int] | None, shift: int, end: int) -> bool:
    """Whether a place that both windows have splices them; right's places are ``shift`` less, left ends at ``end``.

    It does where both start a pre-token: what follows doesn't depend on what came before. Within a pre-token it does if
    both have the same token there and the pre-token ends alike (or goes on where left ends). Merging gives a sequence of
    tokens if and only if it gives each two neighbours for their own text. The neighbours up to the place and across it
    are neighbours in the left window, those after it in the right one.
    """
    if left is None or right is None:
        return left is None and right is None
    return left[0] == right[0] and left[1] in (right[1] + shift, end)


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def public(name: str) -> str:
    """Where a public vocabulary lies; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)
