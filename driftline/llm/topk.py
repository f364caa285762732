"""Exact top-k search by inner product: a KD-tree per shard.

Vectors are dealt evenly over shards of about ``per_shard`` rows. Each shard is a KD-tree: median splits on the
widest dimension, and for every node the tight box around its vectors. A box bounds a query's score from above by
the sum, over dimensions, of the larger product with the box's two sides. Search is best first: the node with the
highest bound next, until no bound reaches the kth score found. Queries travel in blocks; a block is first searched
in one shard, and the kth scores found there go along to all others. These stand in groups: a task unpacks a group's
trees once and streams all blocks past them, and a block goes from tree to tree with the kth scores found so far, which
bound the next search. So a block travels once per group, and a group reports k rows per query at most.

A shard's tree and a block of queries are single rows of a size bounded by parameters; a task holds the trees of one
group and one block. The blocks meet every shard: that is the query set against all rows, in blocks.

Scores are exact integers; those beyond 64 bits count as the nearest 64-bit number. Ties go to the smaller vec_id.
Vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id. Shorter
vectors count as padded with zeros. A query id that repeats asks once, with its smallest vector; rows that carry the
query's own id are never its candidates. Rows that repeat a vec_id are candidates of their own.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

PER_SHARD, PER_BLOCK, LEAF = 8192, 512, 64
#: Shards whose trees a task holds.
GROUP = 8
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantized(df: DataFrame, vector: str, factor: int = 1024) -> DataFrame:
    """vec_id and v: floor(factor * x) of each component, of the rows that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & fine).select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(factor))).cast("bigint")).alias("v"))


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return {k: z[k] for k in z.files}


def padded(vectors, dims: int = 0) -> np.ndarray:
    dims = max([dims, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def build(ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """ids and v in tree order; nodes: first row, end row, first child (0: a leaf; the second follows it), box."""
    order = np.lexsort((ids,))
    first, end, child, lo, hi = [0], [len(ids)], [0], [], []
    node = 0
    while node < len(first):
        own = v[order[first[node] : end[node]]]
        lo.append(own.min(0) if len(own) else np.zeros(v.shape[1], np.int64))
        hi.append(own.max(0) if len(own) else np.zeros(v.shape[1], np.int64))
        if end[node] - first[node] > leaf and v.shape[1]:
            half = (end[node] - first[node]) // 2
            parts = np.argpartition(own[:, int((hi[-1] - lo[-1]).argmax())], half)
            order[first[node] : end[node]] = order[first[node] : end[node]][parts]
            child[node] = len(first)
            first += [first[node], first[node] + half]
            end += [first[node] + half, end[node]]
            child += [0, 0]
        node += 1
    return {"ids": ids[order], "v": v[order], "first": np.array(first), "end": np.array(end), "child": np.array(child), "lo": np.array(lo), "hi": np.array(hi)}


def search(tree: dict[str, np.ndarray], ids: np.ndarray, q: np.ndarray, least: np.ndarray, known: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the (score, -vec_id) that may be among its k best; with known, only those of least or more."""
    dims = max(q.shape[1], tree["v"].shape[1])
    q, v, lo, hi = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, tree["v"], tree["lo"], tree["hi"]))
    most = max(1, *(int(np.abs(x).max(initial=0)) for x in (q, v)))
    if float(most) ** 2 * max(dims, 1) < EXACT:  # then products and sums are exact in doubles
        q, v, lo, hi = (x.astype(np.float64) for x in (q, v, lo, hi))
    else:
        q, v, lo, hi = (x.astype(object) for x in (q, v, lo, hi))
    zero = q * 0
    # numbers that aren't exact in doubles are Python's, cut to 64 bits
    cut = (lambda x: np.minimum(np.maximum(x, LEAST), MOST)) if q.dtype == object else lambda x: x
    bound = cut(np.maximum(q, zero) @ hi.T + np.minimum(q, zero) @ lo.T)
    first, end, child, own_ids = tree["first"].tolist(), tree["end"].tolist(), tree["child"].tolist(), tree["ids"]
    out = []
    for i in range(len(q)):
        best: list[tuple[int, int]] = []
        own, kth = bound[i].tolist(), (least[i] if known[i] else None)
        heap = [(-own[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if kth is not None and -b < kth:
                break
            if child[node]:
                for c in (child[node], child[node] + 1):
                    if kth is None or own[c] >= kth:
                        heapq.heappush(heap, (-own[c], c))
                continue
            a, z = first[node], end[node]
            scores = cut(v[a:z] @ q[i])
            near = np.arange(z - a) if kth is None else np.flatnonzero(scores >= kth)
            for j in near:
                if own_ids[a + j] == ids[i]:
                    continue
                item = (int(scores[j]), -int(own_ids[a + j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = best[0][0] if kth is None else max(kth, best[0][0])
        out.append(best)
    return out


def _streamed(k: int):
    """Rows stand part by part (a group of shards): first the trees (kind 0), then the blocks (kind 1). A block isn't
    searched again in its home, if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trees = None, {}
        for b in batches:
            for p, kind, shard, block, home, raw in zip(*(b.column(n).to_pylist() for n in ("part", "kind", "shard", "block", "home", "data")), strict=True):
                if p != part:
                    part, trees = p, {}
                if kind == 0:
                    trees[shard] = unpack(raw)
                    continue
                a = unpack(raw)
                best: list[list[tuple[int, int]]] = [[] for _ in a["ids"]]
                for n in sorted(set(trees) - {home}):
                    hits = search(trees[n], a["ids"], a["q"], a["least"], a["known"], k)
                    best = [heapq.nlargest(k, own + more) for own, more in zip(best, hits, strict=True)]
                    for i, own in enumerate(best):
                        if len(own) == k:
                            a["least"][i] = max(a["least"][i], own[-1][0]) if a["known"][i] else own[-1][0]
                            a["known"][i] = True
                flat = [(block, int(i), -n, s) for i, own in zip(a["ids"], best, strict=True) for s, n in own]
                cols = list(zip(*flat, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["block", "query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, per_shard: int = PER_SHARD, per_block: int = PER_BLOCK, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score; ``rows`` and ``queries`` have vec_id and v (array<bigint>)."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(rows.select("vec_id", "v"), "rows")
    shards = max(1, -(-rows.count() // per_shard))

    def trees(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = build(pdf["vec_id"].to_numpy(np.int64), padded(pdf["v"].tolist()))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "tree": [pack(**tree)]})

    # rows are dealt by where they stand in the kept table, so that no value can crowd a shard
    dealt = rows.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int"))
    index = scratch.keep(dealt.groupBy("shard").applyInPandas(trees, "shard int, tree binary"), "index")

    asked = scratch.keep(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // per_block))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["vec_id"].to_numpy(np.int64)
        nothing = np.zeros(len(ids), np.int64)
        block = int(pdf["block"].iloc[0])
        return pd.DataFrame({"block": [block], "home": [block % shards], "asked": [pack(ids=ids, q=padded(pdf["v"].tolist()), least=nothing, known=nothing > 0)]})

    dealt = asked.withColumn("block", (F.monotonically_increasing_id() % blocks).cast("int"))
    blocks_df = scratch.keep(dealt.groupBy("block").applyInPandas(packed, "block int, home int, asked binary"), "blocks")
    scratch.drop("rows", "queries")

    def streamed(trees_: DataFrame, blocks_: DataFrame) -> DataFrame:
        """Both have part, kind, shard, block, home and data."""
        tape = trees_.unionByName(blocks_).repartition("part").sortWithinPartitions("part", "kind", "block")
        return tape.mapInArrow(_streamed(k), "block int, query_id bigint, vec_id bigint, score bigint")

    none = F.lit(None).cast("int")

    def as_trees(part: F.Column) -> DataFrame:
        return index.select(part.cast("int").alias("part"), F.lit(0).alias("kind"), "shard", none.alias("block"), none.alias("home"), F.col("tree").alias("data"))

    at_home = blocks_df.select(F.col("home").alias("part"), F.lit(1).alias("kind"), none.alias("shard"), "block", none.alias("home"), F.col("asked").alias("data"))
    at_home = scratch.keep(streamed(as_trees(F.col("shard")), at_home), "home")

    def bounded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"block": [], "home": [], "asked": []})
        a = unpack(left["asked"].iloc[0])
        by = right.groupby("query_id")["score"].agg(["min", "size"])
        by = by[by["size"] >= k]["min"]
        a["known"] = np.isin(a["ids"], by.index.to_numpy())
        a["least"] = np.array([int(by.get(int(i), 0)) for i in a["ids"]], np.int64)
        return pd.DataFrame({"block": left["block"], "home": left["home"], "asked": [pack(**a)]})

    told = blocks_df.groupBy("block").cogroup(at_home.groupBy("block")).applyInPandas(bounded, "block int, home int, asked binary")
    parts = -(-shards // group)
    others = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("part", F.lit(1).alias("kind"), none.alias("shard"), "block", "home", F.col("asked").alias("data"))
    elsewhere = streamed(as_trees(F.floor(F.col("shard") / group)), others)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = at_home.unionByName(elsewhere).select("query_id", "vec_id", "score")
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
