"""Vector code compression: product codes by a filtering Lloyd iteration.

Vectors are cut into ``parts`` equal consecutive parts; each part position has a codebook of ``entries`` integer vectors.
A round assigns every part to its codebook's nearest entry (squared Euclidean distance, ties to the lower index) and
replaces each entry by the componentwise floor of its parts' mean; entries without parts stay. All numbers are integers,
so results don't depend on how rows are dealt out.

Rows stay where they are read: each task packs its rows into blocks, each with a kd-tree per part position whose nodes have
a tight box and the sum and count of their parts (``build``). A round hands the codebooks to all tasks and passes the
entries down the trees (``assign``): an entry that is nowhere in a node's box nearer than the one best for the box's middle
goes no further, and a node that only one entry reaches is assigned as a whole, by its sum and count. A task returns a row per
part, entry and component; no vector moves or is read from the source again. The blocks are a written table, so a lost
executor costs a task, not a round.

Null vectors and those with null or non-finite components are dropped. Shorter vectors, and those whose length the parts
don't divide, count as padded with zeros. The first codebooks are of the smallest keys, ties by the vector, null keys last;
where fewer rows are kept there are as many entries as rows, and an empty table has none and gives no rows. Rows that
repeat, null keys too, are coded row by row. Components beyond 64 bits count as the nearest 64-bit number, and so do errors.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh

PARTS, ENTRIES, ROUNDS, FACTOR = 8, 16, 6, 4096
#: A block ends at so many rows or components.
PER_BLOCK, CELLS, LEAF = 8192, 1 << 21, 16
MOST = (1 << 63) - 1
_LOW = 0xFFFFFFFF


def build(v: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A kd-tree of vectors, halved at the median of the widest side: ``order`` (rows in tree order), ``v`` in that order;
    by node ``first`` and ``end`` row, ``child`` (0: a leaf; the second follows it), box ``lo`` and ``hi``, and the sum of
    its vectors as ``high * 2**32 + low``, which no sum overflows."""
    order, first, end, child, lo, hi = np.arange(len(v)), [0], [len(v)], [0], [], []
    node = 0
    while node < len(first):
        a, z = first[node], end[node]
        own = v[order[a:z]]
        lo.append(own.min(0))
        hi.append(own.max(0))
        wide = [int(h) - int(n) for h, n in zip(hi[-1], lo[-1], strict=True)]
        if z - a > leaf and any(wide):
            half = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(own[:, wide.index(max(wide))], half)]
            child[node] = len(first)
            first += [a, a + half]
            end += [a + half, z]
            child += [0, 0]
        node += 1
    v, first, end = v[order], np.array(first), np.array(end)
    zero = np.zeros((1, v.shape[1]), np.int64)
    high, low = (np.concatenate([zero, np.cumsum(x, axis=0)]) for x in (v >> 32, v & _LOW))
    return {"order": order, "v": v, "first": first, "end": end, "child": np.array(child), "lo": np.array(lo), "hi": np.array(hi), "high": high[end] - high[first], "low": low[end] - low[first]}


def _wide(*arrays: np.ndarray) -> list[np.ndarray]:
    """As they are if no squared distance passes 64 bits, else as Python's numbers."""
    most = max(int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in arrays)
    dims = max(1, arrays[0].shape[-1])
    return [x.astype(np.int64) if 32 * most * most * dims < MOST else x.astype(object) for x in arrays]


def _nearest(x: np.ndarray, book: np.ndarray, may: np.ndarray) -> np.ndarray:
    """For each x the lowest of the nearest entries that it may have."""
    away = ((x[:, None] - book[None]) ** 2).sum(2)
    return np.where(may, away, MOST if away.dtype != object else 1 << 200).argmin(1)


def assign(tree: dict[str, np.ndarray], book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The entry of each row in tree order; by entry the count, high and low sums; how many distances of rows were computed."""
    v, lo, hi, book = _wide(tree["v"], tree["lo"], tree["hi"], book)
    entries, first, end, child = len(book), tree["first"], tree["end"], tree["child"]
    owner = np.zeros(len(v), np.int64)
    count, high, low = np.zeros(entries, np.int64), np.zeros((entries, v.shape[1]), np.int64), np.zeros((entries, v.shape[1]), np.int64)
    nodes, may, computed = np.array([0]), np.ones((1, entries), bool), 0
    while len(nodes):
        a, z = lo[nodes], hi[nodes]
        best = _nearest(a + z, 2 * book, may)
        own = book[best][:, None]
        u = book[None] - own
        # the least that a place of the box is farther from an entry than from the best: at the corner towards the entry
        margin = (u * (book[None] + own - 2 * np.where(u > 0, z[:, None], a[:, None]))).sum(2)
        may = may & ((margin < 0) | ((margin == 0) & (np.arange(entries) < best[:, None])))
        may[np.arange(len(nodes)), best] = True
        whole = may.sum(1) == 1
        np.add.at(count, best[whole], (end - first)[nodes[whole]])
        np.add.at(high, best[whole], tree["high"][nodes[whole]])
        np.add.at(low, best[whole], tree["low"][nodes[whole]])
        for n, e in zip(nodes[whole].tolist(), best[whole].tolist(), strict=True):
            owner[first[n] : end[n]] = e
        leaf = ~whole & (child[nodes] == 0)
        sizes = (end - first)[nodes[leaf]]
        if len(sizes):
            rows = np.repeat(first[nodes[leaf]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            owner[rows] = e = _nearest(v[rows], book, np.repeat(may[leaf], sizes, axis=0))
            computed += int(np.repeat(may[leaf].sum(1), sizes).sum())
            raw = tree["v"][rows]
            np.add.at(count, e, 1)
            np.add.at(high, e, raw >> 32)
            np.add.at(low, e, raw & _LOW)
        down = ~whole & ~leaf
        nodes, may = np.concatenate([child[nodes[down]], child[nodes[down]] + 1]), np.concatenate([may[down], may[down]])
    return owner, count, high, low, computed


def _packed(v: np.ndarray, parts: int) -> bytes:
    out, wide = io.BytesIO(), v.shape[1] // parts
    trees = [build(v[:, p * wide : (p + 1) * wide]) for p in range(parts)]
    small = np.abs(v).max(initial=0) < 1 << 31 if v.min(initial=0) > -MOST else False
    np.savez(out, **{f"{k}{p}": x.astype(np.int32) if small and k in ("v", "lo", "hi") else x for p, t in enumerate(trees) for k, x in t.items()})
    return out.getvalue()


def _unpacked(raw: bytes, parts: int) -> list[dict[str, np.ndarray]]:
    with np.load(io.BytesIO(raw)) as z:
        return [{k: z[f"{k}{p}"].astype(np.int64) for k in ("order", "v", "first", "end", "child", "lo", "hi", "high", "low")} for p in range(parts)]


def _blocks(dims: int, parts: int, per_block: int):
    """Rows to blocks: the columns but ``v`` as lists, and the trees."""

    def block(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(tables).combine_chunks()
        lists = rows.column("v").combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        v = np.zeros((len(lists), dims), np.int64)
        at = np.repeat(np.arange(len(lists)), sizes)
        v[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        names = [c for c in rows.column_names if c != "v"]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), rows.column(c).combine_chunks()) for c in names]
        return pa.RecordBatch.from_arrays([*whole, pa.array([_packed(v, parts)], pa.binary())], [*names, "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held, rows = max(1, min(per_block, CELLS // dims)), [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, most - rows))
                rows, at = rows + held[-1].num_rows, at + held[-1].num_rows
                if rows == most:
                    yield block(held)
                    held, rows = [], 0
        if rows:
            yield block(held)

    return run


def _sums(books: list[np.ndarray]):
    """Per task a row for each part, entry and component: how many parts are the entry's, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, (entries, wide) = len(books), books[0].shape
        count = np.zeros((parts, entries, wide), object)
        total = np.zeros((parts, entries, wide), object)
        for b in batches:
            for raw in b.column("trees"):
                for p, tree in enumerate(_unpacked(raw.as_py(), parts)):
                    _, n, high, low, _ = assign(tree, books[p])
                    count[p] += n[:, None].astype(object)
                    total[p] += high.astype(object) * (1 << 32) + low.astype(object)
        index = np.indices(count.shape).reshape(3, -1)
        numbers = [pa.array(x.astype(np.int32)) for x in index]
        yield pa.RecordBatch.from_arrays([*numbers, pa.array(count.reshape(-1).tolist(), pa.int64()), pa.array([Decimal(int(x)) for x in total.reshape(-1)], pa.decimal128(38, 0))], ["part", "entry", "place", "n", "total"])

    return run


def _coded(books: list[np.ndarray], names: list[str]):
    """Blocks to rows again, with code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                trees = _unpacked(b.column("trees")[k].as_py(), len(books))
                codes = np.zeros((len(trees[0]["order"]), len(books)), np.int64)
                error = np.zeros(len(codes), object)
                for p, tree in enumerate(trees):
                    codes[tree["order"], p] = owner = assign(tree, books[p])[0]
                    v, book = _wide(tree["v"], books[p])
                    error[tree["order"]] += ((v - book[owner]) ** 2).sum(1).astype(object)
                columns = [b.column(c).slice(k, 1).flatten() for c in names]
                text = ["".join(f"{x:02x}" for x in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array([min(int(x), MOST) for x in error], pa.int64())], [*names, "code", "error"])

    return run


def compress(rows: DataFrame, vector: str, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR, per_block: int = PER_BLOCK) -> tuple[DataFrame, list[np.ndarray]]:
    """The columns of ``rows`` but the vector, with ``code`` (the entries' indexes by part, two hex digits each) and ``error``
    (squared distances summed over parts), and the codebooks by part. Components count as floor(factor * x). On the driver
    are the codebooks and their sums: numbers for each entry and component. Columns named code, error, v or trees of
    the input are replaced."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    scratch = Scratch(rows.sparkSession, "codes")
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    names = [c for c in rows.columns if c not in (vector, "code", "error", "v", "trees")]
    kept = rows.where(F.col(vector).isNotNull() & fine).select(*[f"`{c}`" for c in names], F.transform(x, lambda c: F.floor(c * F.lit(float(factor))).cast("bigint")).alias("v"))
    least = kept.orderBy(F.asc_nulls_last(key), "v").select("v").limit(entries).collect()
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dims = max(1, -(-longest // parts)) * parts
    fields = [kept.schema[c] for c in names]
    blocks = T.StructType([*[T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields], T.StructField("trees", T.BinaryType())])
    held = scratch.keep(kept.mapInArrow(_blocks(dims, parts, per_block), blocks), "blocks")
    first = np.zeros((len(least), dims), np.int64)
    for k, r in enumerate(least):
        first[k, : len(r["v"])] = r["v"]
    books = [first[:, p * (dims // parts) : (p + 1) * (dims // parts)].copy() for p in range(parts)]
    if least:
        for _ in range(rounds):
            sums = held.select("trees").mapInArrow(_sums(books), "part int, entry int, place int, n bigint, total decimal(38,0)")
            for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0").collect():
                books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    coded = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return held.mapInArrow(_coded(books, names), coded), books


def with_group_error(coded: DataFrame, by: str, salts: int = 16) -> DataFrame:
    """``coded`` with ``<by>_error``: its errors summed over equal values of a column, nulls together. Groups are summed
    before they are shuffled; a group's sum is there ``salts`` times, and its rows are dealt over these, so that a group of
    any size meets its sum in many tasks."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    salt, of = fresh(coded.columns, "salt"), fresh(coded.columns, "of")
    sums = coded.groupBy(F.col(by).alias(of)).agg(total.alias(f"{by}_error"))
    sums = sums.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = coded.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return dealt.join(sums, dealt[by].eqNullSafe(sums[of]) & (dealt[salt] == sums[salt])).select(*[dealt[f"`{c}`"] for c in coded.columns], f"{by}_error")
