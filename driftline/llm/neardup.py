"""MinHash near-dedup by a multi-index Hamming join, confirmed on full shingle sets.

A text's signature is ``chunks * width`` b-bit MinHash values (b = 32). Two signatures that differ in at most
``chunks * (errors + 1) - 1`` values agree, in some chunk, in all but ``errors`` values (pigeonhole). So each
signature is filed, chunk by chunk, under every way to leave ``errors`` values out; all pairs under that distance meet
under some key. With 12 chunks of 5 values and 1 error that is a distance of 23 of 60. A pair of similarity 0.75 that
is further apart by chance still meets unless all 12 chunks have two errors: it is missed once in 160,000 times.

Equal sets are one representative from the start, the smallest doc_id. The smallest representative under a key is its
hub, and every pair that meets under the key is among the hub's texts. A hub with few texts has all of its pairs compared
in one task. One with many is a star first: each text meets the hub's own, in as many tasks as there are blocks of texts,
and one set is held at a time. Near copies mostly end there, linked with the hub. The texts that aren't linked with it
then meet all others, block by block; what is linked with the hub is one group already and isn't compared again. A task
reports a spanning forest of the links it found: rows stay in proportion to texts, not pairs. Blocks are bounded by the
sets' size. Components of the links give the result.

Tables are joined by shuffling. Where a few rows of a large table are wanted, a screen (a bitmap of fixed size, broadcast)
first drops most others where they lie, at every size alike.

Null texts and texts without words have no shingles and no links. Rows that repeat a doc_id are copies of each other
as far as their texts are; rows with a null doc_id are linked with nothing and have no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, screen, screened, slices, texts
from .components import components
from .shingles import WORDS, mixed, shingle_sets

CHUNKS, WIDTH, ERRORS = 12, 5, 1
SIMILAR = 75
#: A block weighs this much at most; a text weighs 1 and 1 more per WEIGHT shingles.
BLOCK, WEIGHT = 256, 4096
COLUMNS = 4096
#: As a group's second block: the group is a star, its first row the hub's own set.
STAR = -1

_rng = np.random.default_rng(77)
_A = (_rng.integers(0, 1 << 32, CHUNKS * WIDTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, CHUNKS * WIDTH, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """The least value of each hash function over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (a[:, None] * x[None, at : at + 2048] + b[:, None]).min(1), out=least)
    return least


def keys(sigs: np.ndarray, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS) -> np.ndarray:
    """For each signature (a row) one key for each chunk and each choice of values to leave out."""
    by_chunk = sigs.astype(np.uint64).reshape(len(sigs), chunks, width)
    out = []
    for n, left in enumerate(combinations(range(width), width - errors)):
        h = np.broadcast_to(np.arange(chunks, dtype=np.uint64) * np.uint64(1000) + np.uint64(n), (len(sigs), chunks))
        for c in left:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + by_chunk[:, :, c])
        out.append(h)
    return np.concatenate(out, axis=1).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null: empty), keys (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(texts(b.column("text")))
            digests = [_digest(s) for s in sets]
            filed = [k if len(s) else None for k, s in zip(keys(np.array([signature(s) for s in sets])), sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(filed, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>")


def links(sets: list[np.ndarray], side: np.ndarray | None = None, similar: int = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= similar * union; with side, of pairs across sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if n <= 3:
        shared = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        all_, count = np.unique(np.concatenate(sets), return_counts=True)
        all_ = all_[count > 1]
        where = [np.searchsorted(all_, s[np.isin(s, all_, assume_unique=True)]) for s in sets]
        dense = np.zeros((n, n), np.float32)
        for at in range(0, len(all_), COLUMNS):
            m = np.zeros((n, min(COLUMNS, len(all_) - at)), np.float32)
            for i, w in enumerate(where):
                m[i, w[np.searchsorted(w, at) : np.searchsorted(w, at + COLUMNS)] - at] = 1
            dense += m @ m.T
        shared = dense.astype(np.int64)  # sums of ones, exact up to 2^24
    hit = 100 * shared >= similar * (size[:, None] + size[None, :] - shared)
    if side is not None:
        hit &= side[:, None] != side[None, :]
    np.fill_diagonal(hit, False)
    root = np.arange(n)
    out = []
    for i, j in zip(*np.nonzero(np.triu(hit)), strict=True):
        a, b = root[i], root[j]
        if a != b:
            root[root == max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def alike(one: np.ndarray, other: np.ndarray, similar: int = SIMILAR) -> bool:
    """Whether two sets (ascending) reach the similarity."""
    if len(one) > len(other):
        one, other = other, one
    if not len(one) or 100 * len(one) < similar * len(other):
        return False
    shared = int((other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one).sum())
    return 100 * shared >= similar * (len(one) + len(other) - shared)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows stand group by group: (hub, one, two), with rep, block and the set's hashes; a star's hub is its first row."""
    group, ids, sides, sets = None, [], [], []

    def made() -> pa.RecordBatch | None:
        if group[2] == STAR:
            found = [(0, i) for i in range(1, len(ids))]
        else:
            found = links(sets, None if group[1] == group[2] else np.array(sides)) if len(ids) > 1 else []
        if found:
            a, b = zip(*((ids[i], ids[j]) for i, j in found), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["hub", "a", "b"])
        return None

    for b in batches:
        hub, one, two, rep, block = (b.column(n).to_pylist() for n in ("hub", "one", "two", "rep", "block"))
        lists = b.column("set")
        flat, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        for i in range(b.num_rows):
            mine = (hub[i], one[i], two[i])
            if mine != group:
                if group and (out := made()):
                    yield out
                group, ids, sides, sets = mine, [], [], []
            own = flat[at[i] : at[i + 1]]
            if two[i] != STAR:
                sides.append(block[i])
                sets.append(own.copy())
            elif not sets:
                sets.append(own.copy())
            elif rep[i] == ids[0] or not alike(sets[0], own):
                continue
            ids.append(rep[i])
    if group and (out := made()):
        yield out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        own = [s.view(np.int64) for s in shingle_sets(texts(b.column("text")))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own, pa.list_(pa.int64()))], ["rep", "set"])


def _blocks(weight: F.Column, block: int) -> F.Column:
    return F.ceil(F.coalesce(weight, F.lit(0)) / block).cast("int")


def _compared(meets: DataFrame, sets: DataFrame) -> DataFrame:
    """hub, a, b: the links found in groups (hub, one, two) of ``meets``."""
    grouped = meets.join(sets, "rep").repartition("hub", "one", "two").sortWithinPartitions("hub", "one", "two", F.col("rep") != F.col("hub"))
    return grouped.select("hub", "one", "two", "rep", "block", "set").mapInArrow(_linked, "hub bigint, a bigint, b bigint")


def _spokes(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """hub, rep, weight: the representatives that meet under some key, each with the smallest one under it."""
    filed = reps.select(F.explode(F.array_distinct("keys")).alias("key"), "rep")
    hubs = scratch.keep(filed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("key", "hub"), "hubs")
    weighed = reps.select(F.explode(F.array_distinct("keys")).alias("key"), "rep", (1 + F.expr(f"n_shingles div {WEIGHT}")).alias("weight"))
    met = screened(weighed, "key", screen(hubs, "key")).join(hubs, "key")
    # a repeated id can stand for several sets; the heaviest counts
    return scratch.keep(met.groupBy("hub", "rep").agg(F.max("weight").alias("weight")), "spokes")


def _links(docs: DataFrame, spokes: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """a, b: links among each hub's texts, enough of them to connect all that are connected."""
    wanted = spokes.select(F.col("rep").alias("doc_id"))
    chosen = screened(docs, "doc_id", screen(wanted, "doc_id")).join(wanted.distinct(), "doc_id", "left_semi")
    sets = scratch.keep(chosen.mapInArrow(_sets, "rep bigint, set array<bigint>"), "sets")
    large = scratch.keep(spokes.groupBy("hub").agg(_blocks(F.sum("weight"), block).alias("blocks")).where("blocks > 1"), "large")
    place = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    few = spokes.join(large, "hub", "left_anti").select("hub", F.lit(0).alias("one"), F.lit(0).alias("two"), "rep", F.lit(0).alias("block"))
    stars = spokes.where("rep <> hub").join(large, "hub").select("hub", place.alias("one"), F.lit(STAR).alias("two"), "rep", F.lit(0).alias("block"))
    centres = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"), F.lit(STAR).alias("two"), F.col("hub").alias("rep"), F.lit(0).alias("block"))
    found = scratch.keep(_compared(few.unionByName(stars).unionByName(centres), sets), "links")
    # of large hubs: far texts aren't linked with the hub, near ones are
    near = found.join(large, "hub").select("hub", F.col("b").alias("rep"), F.lit(True).alias("near")).distinct()
    sides = spokes.join(large.select("hub"), "hub").join(near, ["hub", "rep"], "left").withColumn("near", F.coalesce("near", F.col("rep") == F.col("hub")))
    sides = scratch.keep(sides, "sides")
    counts = sides.groupBy("hub").agg(_blocks(F.sum(F.when(~F.col("near"), F.col("weight"))), block).alias("far"), _blocks(F.sum(F.when(F.col("near"), F.col("weight"))), block).alias("close"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("near"), F.col("close")).otherwise(F.col("far"))).cast("int")
    placed = sides.join(counts.where("far > 0"), "hub").withColumn("block", F.when(F.col("near"), F.col("far") + own).otherwise(own))
    # far blocks meet all, near ones the far ones
    last = F.when(F.col("near"), F.col("far")).otherwise(F.col("far") + F.col("close")) - 1
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("hub", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "rep", "block")
    more = scratch.keep(_compared(meets, sets), "more_links")
    scratch.drop("sets", "large", "sides")
    return found.unionByName(more).select("a", "b")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (it is the row's own) and digest of the set
    (null: empty) of each row. Ids have to be integers."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = _checked(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    drawn = scratch.keep(sketches(docs), "sketches")
    known = drawn.where("doc_id is not null and digest is not null")
    # equal sets have equal keys, so any copy's will do; a group of copies is one row before it is shuffled
    reps = scratch.keep(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "reps")
    spokes = _spokes(reps, scratch)
    scratch.drop("hubs")
    label = components(_links(docs, spokes, scratch, block), scratch)
    # digests that stand for more than a row of their own, with the component of their texts
    named = reps.join(label, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    named = scratch.keep(named.where("copies > 1 or component_id <> rep").select("digest", "component_id"), "named")
    scratch.drop("reps", "spokes", "links", "more_links")
    # rows without a set have digests of their own, so that they don't crowd one task
    sought = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("digest")), F.concat(F.lit("-").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary")))
    own = drawn.select("doc_id", "n_shingles", "digest", sought.alias("sought"))
    out = own.join(named.withColumnRenamed("digest", "sought"), "sought", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "digest")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "digest")


def _checked(docs: DataFrame) -> DataFrame:
    """The ids have to be integers: others would be cut to one, and meet."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"doc_id has to be an integer, not {kind.simpleString()}")
    return docs


def _order(rows: DataFrame) -> F.Column:
    """What rows are compared by: their columns, or their JSON where a column has no order."""

    def ordered(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return all(ordered(f.dataType) for f in kind.fields)
        return ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))

    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return whole if all(ordered(f.dataType) for f in rows.schema.fields) else F.to_json(whole)


def deduplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, one for each group; of rows with a repeated id, those whose own
    set is kept, and one of those alike in id and set (the least, by all columns, or by their JSON where one of them, as a map,
    has no order). Rows with a null id all stay. Ids have to be integers."""
    scratch = Scratch(docs.sparkSession, "deduplicated")
    found = scratch.keep(near_duplicates(docs, block).select("doc_id", "kept", F.coalesce("digest", F.lit("").cast("binary")).alias("digest")), "found")
    id_, again_, digest = (fresh(docs.columns, n) for n in ("own_id", "is_again", "own_digest"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # ids that aren't simply kept: most rows have another one and stay where they are
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay"))
    unsure = scratch.keep(ids.where("rows > 1 or stay = 0").select(F.col("doc_id").alias(id_), (F.col("rows") > 1).alias(again_)), "unsure")
    marks = screen(unsure, id_)
    known = docs.withColumn(id_, F.col("doc_id").cast("bigint"))
    met = screened(known, id_, marks).join(unsure, id_, "left")
    sure = screened(known, id_, marks, within=False).select(columns).unionByName(met.where(F.col(again_).isNull()).select(columns))

    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_digest(s) or b"" for s in sets], pa.binary())], [*b.schema.names, digest])

    again = met.where(again_).drop(again_)
    again = again.mapInArrow(with_digest, T.StructType([*again.schema.fields, T.StructField(digest, T.BinaryType())]))
    stay = found.where("kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).distinct()
    one = again.join(stay, [id_, digest], "left_semi").groupBy(id_, digest).agg(F.min_by(F.struct(*columns), _order(docs)).alias("row"))
    return sure.unionByName(one.select("row.*"))
