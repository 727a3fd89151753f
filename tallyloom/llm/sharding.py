"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points (virtual nodes) of a ring.  A row's hash lies on an arc,
and the shard at the arc's clockwise end takes it, while that shard has room; the rows of
an arc that find it full go on clockwise to the next point whose shard has room.  Capacities
add up to the number of rows, so counts end at most one apart.

The overflow is decided per arc, not per row: rows of an arc are alike in where they may
go, so their number is all that matters.  The ring has ``shards * points`` arcs, whatever
the size of the data.  A row then needs only its place within its arc.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .base import unused

POINTS = 64                 # virtual nodes of a shard
BIN = 1 << 12               # rows numbered together, about


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """``(position, shard)`` of all virtual nodes in ring order; 32-bit positions.  A shard's
    nodes depend on its number alone, so one more shard moves no other's."""
    return sorted((int.from_bytes(hashlib.sha256(f"{s}/{p}".encode()).digest()[:4], "big"), s)
                  for s in range(shards) for p in range(points))


def capacities(rows: int, shards: int) -> list[int]:
    """Counts at most one apart that add up to ``rows``."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def overflow(counts: Sequence[int], owners: Sequence[int], room: Sequence[int]
             ) -> list[tuple[int, int, int, int]]:
    """Where the rows of each arc go: ``(arc, first place, one past the last, shard)``.

    Arc k belongs to shard ``owners[k]``.  First each shard serves its own arcs in ring
    order; what is left of an arc then goes on clockwise, all arcs in step, and enters the
    next shard that has room.
    """
    room, moves = list(room), []
    left = []                                       # (arc, places given out, rows left)
    for arc, n in enumerate(counts):
        take = min(n, room[owners[arc]])
        room[owners[arc]] -= take
        if take:
            moves.append((arc, 0, take, owners[arc]))
        if n > take:
            left.append((arc, take, n - take))
    for arc, done, n in left:
        at = arc
        while n:
            at = (at + 1) % len(owners)
            take = min(n, room[owners[at]])
            if take:
                room[owners[at]] -= take
                moves.append((arc, done, done + take, owners[at]))
                done, n = done + take, n - take
    return moves


def cells(nodes: Sequence[tuple[int, int]], bits: int = 12) -> list[tuple]:
    """The ring in equal cells: ``(cell, nodes before it, positions of the nodes in it)``."""
    inside: list[list[int]] = [[] for _ in range(1 << bits)]
    for position, _ in nodes:
        inside[position >> (32 - bits)].append(position)
    before, out = 0, []
    for cell, positions in enumerate(inside):
        out.append((cell, before, positions))
        before += len(positions)
    return out


def assign(docs: DataFrame, shards: int, *, key: str = "doc_id", points: int = POINTS,
           shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each).

    A row's place on the ring is the hash of its key.  Null keys share one place, and rows
    with equal keys another, however many: within an arc, rows are told apart by the hash
    of the whole row and by where they lie in the table, so that even equal rows spread
    over tasks and, as shards fill up, over shards.  Columns of any name are kept, but for
    ``shard`` and ``slot``, which are replaced; an empty table stays empty.  The rows are
    written once, as their counts come first.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in (shard.lower(), slot.lower())]
    n: dict[str, str] = {}
    for k in ("place", "arc", "order", "row", "bin", "side"):
        n[k] = unused([*own, shard, slot, *n.values()], f"_{k}")
    place, arc, order, row = (F.col(n[k]) for k in ("place", "arc", "order", "row"))
    side = F.col(n["side"])

    nodes = ring(shards, points)
    # 4,096 cells and, below, two moves per arc at most: bounded by shards * points
    table = F.broadcast(spark.createDataFrame(
        cells(nodes), "c int, before int, inside array<bigint>").select(
        F.struct("*").alias(n["side"])))
    placed = docs.select(*own).withColumn(n["place"], F.shiftrightunsigned(
        F.xxhash64(F.col(key), F.lit("ring")), 32))
    found = placed.join(table, F.shiftright(place, 20) == side["c"])
    index = side["before"] + F.size(F.filter(side["inside"], lambda p: p < place))
    rows = staged(found.withColumn(n["arc"], index % len(nodes))
                  .withColumn(n["order"], F.xxhash64(*own))
                  .withColumn(n["row"], F.monotonically_increasing_id())
                  .drop(n["side"], n["place"]))

    counts = [0] * len(nodes)
    for r in rows.groupBy(arc.alias("arc")).count().collect():      # the ring's size at most
        counts[r["arc"]] = r["count"]
    total = sum(counts)
    moves, filled = [], [0] * shards
    for a, lo, hi, s in overflow(counts, [s for _, s in nodes], capacities(total, shards)):
        moves.append((a, lo, hi, s, filled[s]))
        filled[s] += hi - lo

    # places within an arc: number the rows of small bins, then add up the bins before
    bins = max(1, -(-total // (len(nodes) * BIN)))
    number = F.pmod(F.xxhash64(order, F.shiftright(row, 12)), F.lit(bins))
    rows = rows.withColumn(n["bin"], number)
    here = F.col(n["bin"])
    sizes = rows.groupBy(arc.alias("a"), here.alias("b")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("a").orderBy("b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    starts = sizes.select(F.struct("a", "b", before.alias("before")).alias(n["side"]))
    at = F.row_number().over(Window.partitionBy(arc, here).orderBy(order, row)) - 1
    rows = rows.withColumn(n["place"], at).join(
        starts, (arc == side["a"]) & (here == side["b"]))
    rows = rows.withColumn(n["place"], place + side["before"]).drop(n["side"])
    steps = F.broadcast(spark.createDataFrame(
        moves, "a int, lo bigint, hi bigint, shard int, base bigint").select(
        F.struct("*").alias(n["side"])))
    return rows.join(steps, (arc == side["a"]) & (place >= side["lo"]) & (place < side["hi"])
                     ).select(*own, side["shard"].alias(shard),
                              (side["base"] + place - side["lo"]).alias(slot))
