"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Each shard owns ``vnodes`` places on a ring of 2^32 points, and with them the arc before each place. A row's key
falls into one arc. Arcs are served clockwise; rows that find the arc's shard full go on clockwise to the next arc
whose shard has room, so no shard exceeds its bound. Rows within an arc are ordered by ring point, key, size and
checksum; rows that tie in all of these are alike.

Only the number of rows per arc goes to the driver: shards * vnodes numbers, however many rows there are. The
driver walks them round the ring and returns ranges of places within an arc, each with a shard and a first slot.
One shuffle then numbers the rows within their arcs (a few bytes a row, no texts) and each row looks up its range.

With ``slack`` 0 the bounds add up to the number of rows, so counts are at most one apart; a larger slack leaves
room and moves fewer rows when the input changes. A null text has size 1 and the checksum of the empty string; null
keys share one point and overflow like any other rows. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = 1 << 32
VNODES = 64


def places(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(point, shard) of each virtual node, clockwise; the arc up to and with the point belongs to it."""
    return sorted((int(md5(f"shard {s} place {v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(vnodes))


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """What each shard may hold: an equal part of the rows times 1 + slack, rounded so that the sum suffices."""
    total = max(rows, int(rows * (1 + slack)))
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(per_arc: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, first rank, end rank, shard, first slot): each arc's rows go to its shard, the rest clockwise."""
    room, used, out, n = [*room], [0] * len(room), [], len(owners)
    for arc, left in enumerate(per_arc):
        rank, at = 0, arc
        while left:
            shard = owners[at]
            take = min(left, room[shard] - used[shard])
            if take:
                out.append((arc, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank += take
                left -= take
            at = (at + 1) % n
    return out


def point(key: Column) -> Column:
    """The key's place on the ring."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(0))


def _arc(point_: Column, ring: list[tuple[int, int]]) -> Column:
    """The first place at or after the point, found by counting smaller ones within the point's slice of the ring."""
    # the ring is cut into equal slices; each slice knows how many places lie before it and which lie in it
    cuts = 1 << max(1, (len(ring) - 1).bit_length())
    width = RING // cuts
    points = [p for p, _ in ring]
    before = [bisect_left(points, k * width) for k in range(cuts + 1)]
    starts = F.expr(f"array({', '.join(map(str, before[:-1]))})")
    slices = (", ".join(f"{p}L" for p in points[a:z]) for a, z in zip(before, before[1:], strict=False))
    inside = F.expr(f"array({', '.join(f'cast(array({x}) as array<bigint>)' for x in slices)})")
    k = F.shiftright(point_, RING.bit_length() - 1 - (cuts.bit_length() - 1)).cast("int")
    return ((F.element_at(starts, k + 1) + F.size(F.filter(F.element_at(inside, k + 1), lambda p: p < point_))) % len(ring)).cast("int")


def shard(rows: DataFrame, key: str, shards: int, vnodes: int = VNODES, slack: float = 0.0, order: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with shard and slot (gapless from 0 within a shard); give it the few columns that have to travel."""
    from pyspark.sql import Window

    ring = places(shards, vnodes)
    owners = [s for _, s in ring]
    arcs = rows.select(_arc(point(F.col(key)), ring).alias("_arc")).groupBy("_arc").count()
    per_arc = [0] * len(ring)
    for r in arcs.collect():  # at most shards * vnodes rows
        per_arc[r["_arc"]] = r["count"]
    ranges = walk(per_arc, owners, bounds(sum(per_arc), shards, slack))
    by_arc: dict[int, list] = {}
    for arc, first, end, s, slot in ranges:
        by_arc.setdefault(arc, []).append((first, end, s, slot))
    spark = rows.sparkSession
    # at most shards * (vnodes + 1) ranges: each one ends an arc or fills a shard
    plan = spark.createDataFrame([(a, [tuple(x) for x in v]) for a, v in by_arc.items()], "_arc int, _ranges array<struct<first:bigint,end:bigint,shard:int,slot:bigint>>")
    ranked = (
        rows.withColumn("_point", point(F.col(key)))
        .withColumn("_arc", _arc(F.col("_point"), ring))
        .withColumn("_rank", (F.row_number().over(Window.partitionBy("_arc").orderBy("_point", key, *order)) - 1).cast("long"))
    )
    hit = F.filter("_ranges", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["end"]))[0]
    return (
        ranked.join(F.broadcast(plan), "_arc")
        .withColumn("_hit", hit)
        .withColumn("shard", F.col("_hit.shard"))
        .withColumn("slot", F.col("_hit.slot") + F.col("_rank") - F.col("_hit.first"))
        .drop("_arc", "_point", "_rank", "_ranges", "_hit")
    )
