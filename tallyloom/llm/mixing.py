"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S is to be taken T / S times: the whole part
for certain, the fraction by chance.  The fractions are not rounded one by one.  Two open
documents meet, and mass moves from one to the other, at random in either direction, until
one of the fractions is 0 or 1; mass is fraction times size, so the words taken never
change while each document keeps its probability.  One open document is left of each
block of documents, the open documents of many blocks meet in blocks again, and so on up a
tree, until each source has one, which is rounded by itself.

Blocks are named by the data (source, size class, hash), and each meeting draws its number
from the hash of the row that comes in, so neither the partitioning nor a repeated task
changes the outcome.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.rows import attach_row
from ..session import ship_by_value, staged
from .base import WORD, text_of, unused

ship_by_value(__name__)

BLOCK = 512                 # rows that meet in one block, about
TINY = 1e-9                 # fractions nearer than this to 0 or 1 are there


def target_sizes(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of ``sizes(source, weight, source_size)``: adds ``target``.

    The sources share ``share`` of all sizes by weight; none gets more than ``most`` times
    its size, and what it can't take goes to the others by weight.  So a target is the
    smaller of the cap and a level times the weight; sources meet their caps in the order
    of cap / weight.  One row per source: the window over them is as small as the
    mixture's definition.
    """
    cap, weight = F.col("source_size") * F.lit(most), F.col("weight")
    before = Window.partitionBy(F.lit(0)).orderBy("_full", "source").rowsBetween(
        Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    capped = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    left = F.sum(weight).over(every) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    level = (F.sum("source_size").over(every) * F.lit(share) - capped) / left
    ranked = sizes.withColumn("_full", cap / weight).withColumn("_level", level)
    # the first source that stays below its cap fixes the level for those after it
    found = ranked.where("_level <= _full").agg(
        F.min_by("_level", F.struct("_full", "source")).alias("_level"))
    return attach_row(sizes, found).select(*sizes.columns, F.least(
        cap, F.coalesce(F.col("_level") * weight, cap)).cast("double").alias("target"))


def word_counts(docs: DataFrame, text: str = "text", out: str = "size") -> DataFrame:
    return docs.withColumn(out, F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint"))


def repeating_weights(sized: DataFrame, weights: Sequence[float], *, source: str = "source",
                      size: str = "size") -> DataFrame:
    """``source, source_size, weight``: weights in turn, by the sources' code points, null
    last."""
    sums = sized.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(
        F.asc_nulls_last("source"))) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    return sums.withColumn("weight", F.get(listed, place % len(weights)))


def size_class(size: Column) -> Column:
    """Quarter octaves of the size, so that sizes that meet differ little."""
    return F.floor(F.log2(size) * 4).cast("int")


def settle(p: float, size: float, q: float, other: float, draw: float
           ) -> tuple[float, float]:
    """One meeting: fractions ``p`` and ``q`` of documents of these sizes afterwards, one of
    them 0 or 1.  ``p * size + q * other`` and both expectations stay."""
    up = min((1 - p) * size, q * other)          # mass that may go to the first
    down = min(p * size, (1 - q) * other)
    if draw * (up + down) < down:
        p, q = p + up / size, q - up / other
    else:
        p, q = p - down / size, q + down / other
    snap = lambda x: 0.0 if x < TINY else 1.0 if x > 1 - TINY else x
    return snap(p), snap(q)


def _meet(rows: DataFrame, n: dict[str, str], source: str) -> DataFrame:
    """Meetings within blocks, larger documents first, so that the one left is small.  At
    most one row of a block stays open."""
    block, part = n["block"], n["part"]
    # blocks are numbered within their source
    ready = rows.repartition(block, source).sortWithinPartitions(
        block, source, F.desc(n["size"]), n["order"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None             # the open row of the last block, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            numbers, sizes, draws, parts = [table.column(n[c]).to_pylist()
                                            for c in ("block", "size", "draw", "part")]
            blocks = list(zip(numbers, table.column(source).to_pylist()))
            open_ = here = None
            for k, b in enumerate(blocks):
                if b != here:
                    here, open_ = b, None
                if not 0 < parts[k] < 1:
                    continue
                if open_ is None:
                    open_ = k
                    continue
                parts[open_], parts[k] = settle(parts[open_], sizes[open_], parts[k],
                                                sizes[k], draws[k])
                if 0 < parts[k] < 1:
                    open_ = k
                elif not 0 < parts[open_] < 1:
                    open_ = None
            table = table.set_column(table.column_names.index(part), part,
                                     pa.array(parts, pa.float64()))
            held = None
            if open_ is not None:
                held = table.slice(open_, 1).combine_chunks().to_batches()[0]
                table = pa.concat_tables([table.slice(0, open_), table.slice(open_ + 1)])
            yield from table.to_batches()
        if held is not None:
            yield held

    return ready.mapInArrow(run, rows.schema)


def _placed(rows: DataFrame, n: dict[str, str], source: str, level: int, seed: int,
            block: int) -> DataFrame:
    """Block and draw of each open row at one level of the tree.

    The open rows of a source stand in the order of their size classes, by hash inside a
    class, and are cut into blocks of about ``block``: neighbouring classes share blocks, so
    a source has fewer blocks than open rows, and every level settles some.  The table of
    counts has a row per source and size class.
    """
    part = F.col(n["part"])
    is_open = (part > 0) & (part < 1)
    kind = size_class(F.col(n["size"]))
    counts = rows.where(is_open).groupBy(F.col(source).alias("s"), kind.alias("c")).agg(
        F.count("*").alias("rows"))
    larger = F.sum("rows").over(Window.partitionBy("s").orderBy(F.desc("c")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    counts = staged(counts.select(F.struct(
        "s", "c", "rows", larger.alias("larger"),
        F.sum("rows").over(Window.partitionBy("s")).alias("all")).alias(n["rate"])))
    side = F.col(n["rate"])
    joined = rows.join(counts, rows[source].eqNullSafe(side["s"]) & (kind == side["c"])
                       & is_open, "left")
    # equal counts per block; a hash leaves some blocks larger, none beyond all rows
    place = side["larger"] + F.pmod(
        F.xxhash64(n["order"], F.lit(level), F.lit("block")), side["rows"])
    number = F.floor(place / F.ceil(side["all"] / F.ceil(side["all"] / F.lit(block))))
    draw = F.shiftrightunsigned(F.xxhash64(n["order"], F.lit(level), F.lit(seed)), 11)
    return (joined.withColumn(n["block"], F.coalesce(
                number.cast("bigint"),
                # rows that are settled already go anywhere
                -1 - F.pmod(F.col(n["order"]), F.lit(1 << 20))))
            .withColumn(n["draw"], draw * F.lit(2.0 ** -53)).drop(n["rate"]))


def mix(docs: DataFrame, targets: DataFrame, *, source: str = "source", size: str = "size",
        seed: int = 42, block: int = BLOCK, copies: str = "copies") -> DataFrame:
    """``docs`` with ``copies``: how often the mix takes each row.

    ``targets`` has one row per source with ``source``, ``source_size`` and ``target``; null
    stands for rows without a source.  A source's taken size differs from its target by
    less than one document.  Rows of size zero or null are rounded by themselves, as they
    weigh nothing; rows of a source without a target are not taken.  Equal rows are each
    drawn for.  Columns of any name are kept, but for ``copies``, which is replaced; an
    empty table stays empty.
    """
    if block < 2:
        raise ValueError("a block has two rows at least")
    own = [c for c in docs.columns if c != copies]
    n: dict[str, str] = {}
    for k in ("whole", "part", "size", "draw", "order", "block", "rate"):
        n[k] = unused([*own, copies, *n.values()], f"_{k}")
    side = staged(targets.select(F.struct(
        F.col("source").alias("s"), F.try_divide("target", "source_size").alias("r")
    ).alias(n["rate"])))
    rate = F.coalesce(F.col(n["rate"])["r"], F.lit(0.0))
    fraction = rate - F.floor(rate)
    order = F.xxhash64(*own, F.lit(seed))
    alone = F.shiftrightunsigned(F.xxhash64(F.col(n["order"]), F.lit("alone")), 11) \
        * F.lit(2.0 ** -53)
    rows = (docs.select(*own).join(side, docs[source].eqNullSafe(F.col(n["rate"])["s"]), "left")
            .withColumn(n["whole"], F.floor(rate).cast("bigint"))
            .withColumn(n["size"], F.coalesce(F.col(size).cast("double"), F.lit(0.0)))
            .withColumn(n["order"], order)
            .withColumn(n["part"], F.when(fraction < TINY, 0.0)
                        .when(F.col(n["size"]) > 0, fraction)
                        .otherwise((alone < fraction).cast("double")))
            .drop(n["rate"]))
    part = F.col(n["part"])
    done, level = [], 0
    while True:
        rows = staged(_meet(_placed(rows, n, source, level, seed, block), n, source))
        done.append(rows.where((part <= 0) | (part >= 1)))
        rows = rows.where((part > 0) & (part < 1)).drop(n["block"], n["draw"])
        left = rows.groupBy(source).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if (left or 0) <= 1:
            break
        level += 1
    last = rows.withColumn(n["part"], (alone < part).cast("double"))
    for some in done:
        last = last.unionByName(some.select(*last.columns))
    return last.select(*own, (F.col(n["whole"]) + part.cast("bigint")).alias(copies))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), *,
                    source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns.

    Sizes are words; sources weigh by their code points in turn, and targets share 150 %
    of all words, at most twice a source's own.  Cases as in :func:`mix`.
    """
    size = unused(docs.columns, "_words")
    copies = unused([*docs.columns, size], "_copies")
    sized = word_counts(docs, text, size)
    targets = staged(target_sizes(repeating_weights(sized, weights, source=source, size=size)))
    taken = mix(sized, targets, source=source, size=size, seed=seed, copies=copies)
    times = F.array_repeat(F.lit(0), F.col(copies).cast("int"))
    return taken.withColumn(size, F.explode(times)).select(*docs.columns)
