"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

A document's ids and an end id are cut into pieces of at most ``room`` ids; a piece of just ``room`` is a sequence of
its own, the others are packed. They are dealt evenly over groups of bounded size, and each group over ``ISLANDS``
islands: an island is a task of its own with a population of packings of the group's pieces. The first island starts
from best fit by falling length, all from best fits in other orders as well. A child takes whole well-filled bins of one
parent, drops the other parent's bins that hold any of their pieces, and best-fits what that displaced. Fewer bins are
fitter; among as many bins fitness is the mean square of fill, so that free space gathers in few bins.

Islands evolve for an epoch and write their populations as a table; each then reads its neighbour's best packing from
it (the elite moves on) and evolves for another epoch. The best packing of all islands is the group's. A population
can't get worse, so a group never takes more sequences than best fit by falling length. An island only stops before its
time when all free space is in one bin: nothing is left to gain then.

Among groups, full bins stay, and the pieces of each group's least filled bins are dealt anew, with those of other
groups, until one group is left. So the space that each group can't use adds up only once.

Null text counts as empty: it holds the end id alone. Every row gives at least one piece; repeated rows each have
their own. Columns besides doc_id and text are not read. The draws follow the group's number, so a task that runs again
gives the same result.
"""

from __future__ import annotations

import heapq
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, texts
from .encode import encoder

ROOM, END_ID = 4096, 1
#: A group's pieces fill about so many sequences.
BINS = 256
ISLANDS, MEMBERS, GENERATIONS, EPOCHS = 2, 4, 4, 2
WELL_FILLED = 0.995
#: Share of a group's bins, the least filled, whose pieces are dealt anew: so many at least, and up to a quarter of them (or
#: half, if that is 16 or fewer) if so many aren't full. So each round has fewer groups than the one before.
DISSOLVED = 0.08


def pieces(docs: DataFrame, path: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; ``path`` is the vocabulary file."""
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                ids = enc.ids(text) + end
                for n, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    out.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (b.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Packing(NamedTuple):
    """The items of each bin, and how full it is."""

    bins: list[list[int]]
    fill: list[int]


def best_fit(items: list[int], size: list[int], room: int, start: Packing | None = None) -> Packing:
    """Put each item into the fullest bin that takes it, or a new one; the bins of ``start`` are filled on."""
    bins, fill = start or Packing([], [])
    free = sorted((room - f, n) for n, f in enumerate(fill))
    for i in items:
        need = size[i]
        at = bisect_left(free, (need, -1))
        if at == len(free):
            bins.append([i])
            fill.append(need)
            insort(free, (room - need, len(bins) - 1))
        else:
            left, n = free.pop(at)
            bins[n].append(i)
            fill[n] += need
            if left > need:
                insort(free, (left - need, n))
    return Packing(bins, fill)


def fitness(packing: Packing) -> tuple[int, int]:
    """The least is the fittest: the fewest bins, then the largest mean square of fill."""
    return len(packing.fill), -sum(f * f for f in packing.fill)


def best(packings: list[Packing], members: int = MEMBERS) -> list[Packing]:
    """The fittest, best first."""
    return sorted(packings, key=lambda p: fitness(p))[:members]


def cross(one: Packing, other: Packing, size: list[int], room: int, rnd: random.Random) -> Packing:
    """``one`` with some of the well-filled bins of ``other`` put in."""
    good = [n for n, f in enumerate(other.fill) if f >= WELL_FILLED * room] or list(range(len(other.fill)))
    taken = rnd.sample(good, max(1, len(good) // 2))
    stay, fill = [other.bins[n][:] for n in taken], [other.fill[n] for n in taken]
    held = set().union(*stay)
    displaced, weak = [], []
    for b, f in zip(one.bins, one.fill, strict=True):
        if held.isdisjoint(b):
            weak.append((f, len(stay)))
            stay.append(b[:])
            fill.append(f)
        else:
            displaced += [i for i in b if i not in held]
    # the least filled bins are given up as well, so that what is displaced finds other company
    given_up = {n for _, n in heapq.nsmallest(max(2, len(weak) // 50), weak)}
    for n in given_up:
        displaced += stay[n]
    spread = rnd.choice((0.0, 0.1, 0.4))
    displaced.sort(key=(lambda i: -size[i] * (1 + spread * rnd.uniform(-1, 1))) if spread else lambda i: -size[i])
    kept = [n for n in range(len(stay)) if n not in given_up]
    return best_fit(displaced, size, room, Packing([stay[n] for n in kept], [fill[n] for n in kept]))


def settle(size: list[int], room: int, rnd: random.Random, members: int = MEMBERS, plain: bool = True) -> list[Packing]:
    """An island's first population: best fit in perturbed orders of falling length; with ``plain`` in that order too."""
    order = sorted(range(len(size)), key=lambda i: -size[i])
    first = [best_fit(order, size, room)] if plain else []
    spreads = [0.1 * 2**n for n in range(members - len(first))]
    others = (sorted(order, key=lambda i, by=by: -size[i] * (1 + by * rnd.uniform(-1, 1))) for by in spreads)
    return best([*first, *(best_fit(o, size, room) for o in others)], members)


def evolve(population: list[Packing], size: list[int], room: int, rnd: random.Random, generations: int = GENERATIONS) -> list[Packing]:
    """The population after an epoch, best first."""
    members = len(population)
    for _ in range(generations):
        if members < 2 or sum(f < room for f in population[0].fill) <= 1:
            break
        children = [cross(*rnd.sample(population, 2), size, room, rnd) for _ in range(members - 1)]
        population = best([*population, *children], members)
    return population


def _from_numbers(numbers, size: list[int]) -> Packing:
    """A packing from its items' bin numbers."""
    out = Packing([[] for _ in range(max(numbers, default=-1) + 1)], [0] * (max(numbers, default=-1) + 1))
    for i, n in enumerate(numbers):
        out.bins[n].append(i)
        out.fill[n] += size[i]
    return out


def _numbers(packing: Packing, items: int) -> list[int]:
    out = [0] * items
    for n, b in enumerate(packing.bins):
        for i in b:
            out[i] = n
    return out


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    # an order of its own, so that the result doesn't hang on the order in which rows arrive; rows that tie are alike
    return pdf.sort_values(["length", "ids_crc32", "doc_id", "piece"], ascending=False, na_position="last", kind="stable").reset_index(drop=True)


def _epoch(room: int, epoch: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = _ordered(pdf[pdf["at_home"]])
        size = own["length"].astype(int).tolist()
        group, island = int(own["group"].iloc[0]), int(own["island"].iloc[0])
        rnd = random.Random(group * 1000 + island * 100 + epoch)
        if epoch:
            # a member of the table: each item's bin numbers, one per packing
            population = [_from_numbers(n, size) for n in np.stack(own["packings"].to_numpy()).T.tolist()]
            guests = _ordered(pdf[~pdf["at_home"]])
            if len(guests):
                population = best([*population, _from_numbers([int(n[0]) for n in guests["packings"]], size)])
        else:
            population = settle(size, room, rnd, plain=island == 0)
        population = evolve(population, size, room, rnd)
        numbers = np.array([_numbers(p, len(size)) for p in population], np.int32).T
        return own.assign(packings=pd.Series(list(numbers), index=own.index, dtype=object)).drop(columns="at_home")

    return run


def _placed(room: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one group: the best island's best packing."""
        islands = {n: _ordered(own) for n, own in pdf.groupby("island")}
        size = next(iter(islands.values()))["length"].astype(int).tolist()
        found = {n: _from_numbers([int(x[0]) for x in own["packings"]], size) for n, own in islands.items()}
        chosen = min(found, key=lambda n: (fitness(found[n]), n))
        own, (bins, fill) = islands[chosen], found[chosen]
        poor = sum(f < room for f in fill)
        share = max(1, int(len(bins) * DISSOLVED), min(poor, max(len(bins) // 4, min(len(bins) // 2, 16))))
        weak = set() if last else set(sorted(range(len(bins)), key=lambda n: fill[n])[:share])
        sequence, offset, done = (np.zeros(len(size), t) for t in (np.int64, np.int64, bool))
        for n, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i], done[i] = n, at, n not in weak
                at += size[i]
        return own.drop(columns=["island", "packings"]).assign(sequence_id=sequence, offset=offset, done=done)

    return run


def pack(cut: DataFrame, scratch: Scratch, room: int = ROOM, bins: int = BINS, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``cut`` (as pieces() gives it) with sequence_id and offset. ``bins`` is 4 or more."""
    whole = cut.where(F.col("length") == room).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    names = [*cut.columns, "sequence_id", "offset"]
    out, left, n = whole.select(names), cut.where(F.col("length") < room), 0
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", group bigint"
    while True:
        # by length, as many tiny pieces fit into one sequence; a group has at most room * bins pieces, of length 1
        groups = max(1, -(-(left.agg(F.sum("length")).first()[0] or 0) // (room * bins)))
        # dealt by where rows stand in a kept table, so that no value can crowd a group
        dealt = left.select(*cut.columns, (F.monotonically_increasing_id() % groups).cast("bigint").alias("group"))
        living = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("at_home", F.lit(True))
        for epoch in range(epochs):
            evolved = living.groupBy("group", "island").applyInPandas(_epoch(room, epoch), f"{own}, island int, packings array<int>")
            evolved = scratch.keep(evolved, f"round{n}.epoch{epoch}")
            # the elite moves on: each island also reads its neighbour's rows, of which it takes the best packing
            moved = evolved.withColumn("island", (F.col("island") + 1) % islands).withColumn("packings", F.slice("packings", 1, 1)).withColumn("at_home", F.lit(False))
            living = evolved.withColumn("at_home", F.lit(True))
            living = living.unionByName(moved) if islands > 1 else living
        got = scratch.keep(evolved.groupBy("group").applyInPandas(_placed(room, groups == 1), f"{own}, sequence_id bigint, offset bigint, done boolean"), f"round{n}")
        scratch.drop(*(f"round{n}.epoch{epoch}" for epoch in range(epochs)))
        # a sequence's number: round, group, bin
        numbered = got.where("done").withColumn("sequence_id", F.lit(n << 56) + F.col("group") * (1 << 21) + F.col("sequence_id"))
        out = out.unionByName(numbered.select(names))
        if groups == 1:
            return out
        left, n = got.where("not done").select(cut.columns), n + 1
