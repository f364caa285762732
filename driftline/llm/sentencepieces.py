"""SentencePiece encoding and decoding: shared-prefix forward scores.

A text is marked as the library does it (one mark before it, a mark for each space) and falls into marked words. The
distinct words of a block of documents are sorted, which makes them a trie, and walked depth first: what was found for
the characters that a word shares with the one before is used again, only the rest is computed. For each prefix the
walk keeps its last piece and its score; a word's ids are read backwards from its end.

What a prefix keeps depends on the model's kind:

* unigram: the best sum of scores over the ways to cut the prefix (Viterbi).
* BPE: the highest sum is not what merging gives, so the plain method would give wrong ids here. But merging, too, has
  exactly one result for each prefix, and its pieces are found forward: a piece follows another if merging both
  together gives just the two (a test that is kept per pair of pieces). One piece fits at each prefix, so the same walk
  gives the library's ids.

Characters in no piece become bytes. Runs of several marks are merged after all else and looked up by length. Null
text counts as empty and has no ids; each row gives one row, repeated rows and null ids included.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import slices, texts

MARK = "▁"
#: Documents and characters per block of distinct words.
ROWS, CHARS = 1024, 4_000_000
#: Pairs of pieces whose test is kept, and words per generation.
PAIRS, KEPT = 500_000, 250_000
#: Longer words are forgotten after their block, so that memory is bounded.
LONG = 64
SHORT = (2, 1)


class Model:
    """A model file whose normalization is the identity, with one mark put before the text and bytes as fallback."""

    def __init__(self, path: str | None = None, proto: bytes | None = None, unigram: bool = False):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if path else sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.unigram = unigram
        lib = self.library
        n = lib.get_piece_size()
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece = {i: lib.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.piece.items() if p == MARK or not (p.startswith(MARK * 2) and p.strip(MARK) == "")}
        self.score = {i: lib.get_score(i) for i in plain}
        self.raw = [b""] * n
        for i, p in self.piece.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        by_last: dict[str, set[int]] = {}
        for p in self.ids:
            by_last.setdefault(p[-3:], set()).add(len(p))
        #: the lengths, falling, of the pieces of three or more characters by their last three
        self.lengths = {c: tuple(sorted(v, reverse=True)) + (2, 1) for c, v in by_last.items() if len(c) == 3}
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.newline = "\n" not in "".join(self.ids)
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs: dict[int, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """Merging as defined: the neighbours whose joint piece scores highest, leftmost first, until none is left."""
        return self._merge(text)[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        parts, pair = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                joint = self.ids.get(parts[i] + parts[i + 1])
                if joint is not None and (best is None or self.score[joint] > best):
                    best, at = self.score[joint], i
            if at < 0:
                break
            pair = (parts[at], parts[at + 1])
            parts[at : at + 2] = ["".join(pair)]
        return parts, pair

    def _edge(self, piece: int, side: int) -> list[tuple[str, float, float]]:
        """What stands at the piece's left (0) or right (1) edge while it is being merged, the last first: (part, its
        rank, the rank of the merge that ends it). Ranks are scores with the sign turned: merges go by falling score."""
        found = self.edges[side].get(piece)
        if found is None:
            found, part, until = [], self.piece[piece], float("inf")
            while True:
                parts, pair = self._merge(part) if len(part) > 1 else ([part], None)
                if len(parts) > 1:  # not what its own characters merge to: it never comes up
                    found = []
                    break
                rank = -self.score[self.ids[part]] if pair else float("-inf")
                found.append((part, rank, until))
                if not pair:
                    break
                part, until = pair[side], rank
            self.edges[side][piece] = found
        return found

    def _follows(self, before: int, piece: int) -> bool:
        """Whether merging both pieces' characters together gives just the two: no part at the right edge of one and
        part at the left edge of the other that stand side by side at some time merge before they are gone."""
        ids, score = self.ids, self.score
        left, right = self._edge(before, 1), self._edge(piece, 0)
        if not left or not right:
            return False
        for x, x_from, x_until in left:
            for y, y_from, y_until in right:
                if x_from < y_until and y_from < x_until:
                    joint = ids.get(x + y)
                    # of equal ranks the leftmost goes first: the merge that ends x is left of this one, that of y isn't
                    if joint is not None and -score[joint] < x_until and -score[joint] <= y_until:
                        return False
        return True

    def words(self, sorted_words: list[str]) -> dict[str, list[int]]:
        """The ids of each word, none of which holds a run of marks. last[i]: of the word's first i characters, the
        last piece (below 0: a character in no piece), where it starts, and the score."""
        ids, lengths, fits, score, unigram = self.ids, self.lengths, self.fits, self.score, self.unigram
        piece_at: list[int] = [0]
        from_: list[int] = [0]
        total: list[float] = [0.0]
        out: dict[str, list[int]] = {}
        last = ""
        for word in sorted_words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del piece_at[same + 1 :], from_[same + 1 :], total[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                c = word[end - 1]
                found, start, best = -ord(c) - 1, end - 1, total[end - 1] + self.least
                hit = False
                for n in lengths.get(word[end - 3 : end], SHORT) if end > 2 else SHORT:
                    if n > end:
                        continue
                    piece = ids.get(word[end - n : end])
                    if piece is None:
                        continue
                    if unigram:
                        s = total[end - n] + score[piece]
                        if not hit or s > best:
                            found, start, best, hit = piece, end - n, s, True
                        continue
                    before = piece_at[end - n]
                    if n == end or before < 0:
                        fit = True
                    else:
                        fit = fits.get(before << 20 | piece)
                        if fit is None:
                            if len(fits) >= PAIRS:
                                fits.clear()
                            fit = fits[before << 20 | piece] = self._follows(before, piece)
                    if fit:
                        found, start, best = piece, end - n, 0.0
                        break
                piece_at.append(found)
                from_.append(start)
                total.append(best)
            got: list[int] = []
            end = len(word)
            while end:
                piece = piece_at[end]
                if piece >= 0:
                    got.append(piece)
                else:
                    got += [self.byte_ids[b] for b in reversed(chr(-piece - 1).encode("utf-8", "replace"))]
                end = from_[end]
            got.reverse()
            out[word] = got
            last = word
        return out

    def run(self, marks: int) -> list[int]:
        """The ids of so many marks in a row; the library puts the first one there itself."""
        if marks not in self.runs:
            self.runs[marks] = self.library.encode(" " * (marks - 1)) if marks > 1 else [self.ids[MARK]]
            if len(self.runs) > 4096:
                return self.runs.pop(marks)
        return self.runs[marks]

    def split(self, text: str) -> list[str]:
        """The text cut at spaces, each a mark: a part has a mark before it, unless it starts with a newline, which is
        in no piece and so bounds words. Empty parts are marks with nothing after them."""
        text = text.replace(MARK, " ")
        return (text.replace("\n", " \n") if self.newline else text).split(" ") if text else []

    def _learn(self, parts: set[str]) -> None:
        """Puts the ids of all parts into kept. Frequent parts stay known from block to block, in two generations of
        bounded size."""
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}
        kept, older, new = self.kept, self.older, []
        for part in parts:
            if part not in kept:
                if part in older:
                    kept[part] = older[part]
                else:
                    new.append(part)
        breaks = array("i", [self.byte_ids[10]]).tobytes()
        inside = {p[1:] for p in new if p[:1] == "\n" and self.newline}
        found = self.words(sorted({MARK + p for p in new if p[:1] != "\n" or not self.newline} | inside - {""}))
        for p in new:
            if p[:1] == "\n" and self.newline:
                kept[p] = breaks + array("i", found[p[1:]] if len(p) > 1 else []).tobytes()
            else:
                kept[p] = array("i", found[MARK + p]).tobytes()

    def _with_runs(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of parts among which some are empty."""
        mark = array("i", [self.ids[MARK]]).tobytes()
        empty = 0
        for part in parts:
            if not part:
                empty += 1
                continue
            ids = self.kept[part]
            if empty:
                if part[:1] == "\n" and self.newline:
                    yield array("i", self.run(empty)).tobytes()
                elif ids[:4] == mark:  # the part's own mark joined no piece of it, so it is part of the run
                    yield array("i", self.run(empty + 1)).tobytes()
                    ids = ids[4:]
                else:
                    yield array("i", self.run(empty)).tobytes()
                empty = 0
            yield ids
        if empty:
            yield array("i", self.run(empty)).tobytes()

    def encode(self, block: list[str]) -> list[array]:
        """The ids of each text."""
        cut = [self.split(t) for t in block]
        distinct = set().union(*cut)
        distinct.discard("")
        self._learn(distinct)
        get, out = self.kept.__getitem__, []
        for parts in cut:
            ids = array("i")
            ids.frombytes(b"".join(self._with_runs(parts) if "" in parts else map(get, parts)))
            out.append(ids)
        for part in distinct:
            if len(part) > LONG:
                del self.kept[part]
        return out

    def decode(self, ids) -> str:
        """The text; the mark put before it is taken off."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_made: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _made:
        _made[path] = Model(path)
    return _made[path]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows in blocks of bounded size; one text can be a block."""
    for b in slices(batches, ROWS):
        said = texts(b.column("text"))
        at = size = 0
        for i, t in enumerate(said):
            if size and size + len(t) > CHARS:
                yield b.slice(at, i - at), said[at:i]
                at, size = i, 0
            size += len(t)
        yield b.slice(at), said[at:]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b, said in _blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.tolist() for x in own.encode(said)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), round_trip (decoding gives the text; a mark
    in a text comes back as a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b, said in _blocks(batches):
            ids = own.encode(said)
            cols = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([own.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, said, strict=True)])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_crc32 bigint, round_trip boolean")
