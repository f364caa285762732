"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction (one in ``scale``) of the hash space, besides the smallest
hash, so that a text with words has one. Which hashes stay depends on them alone: the sketch of a union is the union
of sketches (but for smallest hashes), and the share of the smaller sketch found in the larger one estimates
containment, however unequal the documents. A fingerprint is the sketch as text: 12 hex digits a hash, ascending.

``edited_pairs`` also gives each document's edited text (the last half of its code points replaced by the first as
many of the next document) and compares. "Next" is by descending doc_id, null last, ties by the text's hash; after
the last comes the first. Rows are dealt by ranges of doc_id between split points that are ids of the table, and the
first document of a range also goes to the range before, so each text travels once and no order is global. Null text
counts as empty; a single document comes after itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts
from .shingles import shingle_sets

SCALE = 8
DIGITS = 12
PAIRS = 128


def sketch(shingles: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``shingles`` ascend, as shingle_sets() gives them."""
    n = int(np.searchsorted(shingles, np.uint64((1 << 64) // scale)))
    return shingles[: max(n, 1)]


def fingerprint(sketched: np.ndarray) -> str:
    raw = (sketched >> np.uint64(64 - 4 * DIGITS)).astype(">u8").tobytes().hex()
    return "".join(raw[i + 16 - DIGITS : i + 16] for i in range(0, len(raw), 16))


def likeness(one: str, other: str) -> float:
    """The share of the smaller sketch that is in the larger one; two without words are alike, one with none isn't."""
    a, b = ({x[i : i + DIGITS] for i in range(0, len(x), DIGITS)} for x in (one, other))
    if not a or not b:
        return float(not a and not b)
    return len(a & b) / min(len(a), len(b))


def merge(one: str, other: str) -> str:
    """The fingerprint of both texts' shingles together."""
    return "".join(sorted({x[i : i + DIGITS] for x in (one, other) for i in range(0, len(x), DIGITS)}))


def fingerprints(texts_: list[str], scale: int = SCALE) -> list[str]:
    return [fingerprint(sketch(s, scale)) for s in shingle_sets(texts_)]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited_pairs(docs: DataFrame, parts: int, scale: int = SCALE) -> DataFrame:
    """The columns of ``_NAMES`` for each row; ``parts`` ranges of doc_id at most."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text")
    # at most `parts` ids; they are values of the table, so a split point is the first document of its range
    got = base.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("cuts"), F.max("doc_id").alias("top")).first()
    cuts, top = sorted({x for x in got["cuts"] or [] if x != got["top"]} if parts > 1 else [], reverse=True), got["top"]
    splits = F.from_json(F.lit(json.dumps(cuts)), f"array<{kind}>")
    # range 0 holds ids over cuts[0], range p those from cuts[p - 1] down to above cuts[p]; null is in the last
    mine = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(splits, lambda c: F.col("doc_id") <= c)))
    before = F.when(F.array_contains(splits, F.col("doc_id")), mine - 1)
    wrap = F.when(F.col("doc_id").eqNullSafe(F.lit(top)), F.lit(len(cuts)))
    seats = F.filter(F.array(F.struct(mine.alias("part"), F.lit(0).alias("tail")), F.struct(before.alias("part"), F.lit(1).alias("tail")), F.struct(wrap.alias("part"), F.lit(2).alias("tail"))), lambda s: s["part"].isNotNull())
    seated = base.withColumn("seat", F.explode(seats)).select(F.col("seat.part").alias("part"), F.col("seat.tail").alias("tail"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = seated.repartition("part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        said: list[str] = []

        def made(following: str, last: bool) -> pa.RecordBatch:
            """Of all that is held; ``following`` comes after the last of it."""
            chain = [*said, following]
            new = [edited(a, b) for a, b in zip(chain, chain[1:], strict=False)]
            prints = fingerprints([*chain, *new], scale)
            own, of_new = prints[: len(chain)], prints[len(chain) :]
            cols = [ids[:], [len(t) for t in said], [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], own[:-1], of_new, [likeness(a, b) for a, b in zip(own, of_new, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]]
            ids.clear()
            said.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)

        part, size, id_type = None, 0, pa.int64()
        for b in slices(batches):
            id_type = b.column("doc_id").type
            for p, tail, doc, text in zip(b.column("part").to_pylist(), b.column("tail").to_pylist(), b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                if tail:
                    if ids and p == part:
                        yield made(text, True)
                    continue
                if ids and (len(ids) >= PAIRS or size > 1 << 20):
                    yield made(text, False)
                    size = 0
                part = p
                ids.append(doc)
                said.append(text)
                size += len(text)

    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
