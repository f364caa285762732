"""Token counts: overlap resynchronisation.

A text of more than ``huge`` characters is encoded in windows that overlap. Two neighbours are spliced at the first
place, well inside both, that is proven stable (``encode.same``): a pre-token starts there in both, or both have the same
token there within the same pre-token, so texts without spaces splice too. What a window finds before a place depends on
no more than ``MARGIN`` characters after it (one character of lookahead, or a special string not seen whole). Where the
overlap holds no such place the right window starts earlier, and so on until the windows agree or the left one's whole
length is covered; then the left one grows. Memory follows the window, not the text, unless nothing ever agrees.

Null text counts as empty and has no tokens. Every row gives one row, repeated rows and null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .encode import Encoder, encoder, same

HUGE, WINDOW, OVERLAP, MARGIN = 32_768, 16_384, 512, 32


def count_huge(enc: Encoder, text: str, window: int = WINDOW, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """``enc.count(text)``, window by window."""
    total, start, end = 0, 0, min(window, len(text))
    places, before, marks = enc.cuts(text[start:end])
    used = 0  # tokens of this window that stand before the splice to its left
    while end < len(text):
        lap, found = overlap, None
        while found is None:
            left = max(start, end - lap)
            stop = min(len(text), left + max(window, 2 * lap))
            right = enc.cuts(text[left:stop])
            mine = {p + start: (n, m) for p, n, m in zip(places, before, marks, strict=True) if left + margin <= p + start <= end - margin}
            for p, n, m in zip(*right, strict=True):
                if p + left in mine and same(mine[p + left][1], m, left - start, end - start):
                    found = mine[p + left][0], n
                    break
            if found is None and left == start:
                break
            lap *= 2
        if found is None:  # no place agrees: the left window has to grow
            end = min(len(text), start + 2 * (end - start))
            places, before, marks = enc.cuts(text[start:end])
            continue
        total += found[0] - used
        start, end, used, (places, before, marks) = left, stop, found[1], right
    return total + before[-1] - used


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of ``docs``; ``path`` is the vocabulary file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            mine = texts(b.column("text"))
            n = [count_huge(enc, t) if len(t) > huge else enc.count(t) for t in mine]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode("utf-8", "replace")) for t in mine], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
