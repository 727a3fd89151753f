"""Strongly correlated lines without looking at every pair.

A line's centred series is a direction; its sketch has one bit per random plane, the side on
which the direction lies.  Two directions at an angle ``acos(r)`` agree in a bit with the
probability ``1 - acos(r) / pi``.  Bands of some bits are bucket keys, and the pairs of a
bucket whose sketches differ in few bits are candidates.  The opposite direction has the
opposite bits, so a band is turned until its first bit is set, and negative correlations are
found as well.

Projections are sums over days: parts of the day axis are projected by themselves and added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_by_value, staged
from .correlate import _co_moments, _days, _r_of_sums, SUMS, shifted

ship_by_value(__name__)

BITS = 1024
WIDTH = 12                  # bits of a band: a bucket gets one in 2,048 of unrelated lines
RECALL = 0.99               # of pairs exactly at the threshold
SPREADS = 4.0               # standard deviations that a sketch may be off
PART_DAYS = 1024
SEED = 17


def planes(part: int, days: int) -> np.ndarray:
    """Normals of every plane, on the days of one part of the axis."""
    draw = np.random.RandomState((SEED + 1009 * part) % (1 << 32))
    return draw.standard_normal((days, BITS)).astype(np.float32)


def bands(least: float) -> list[np.ndarray]:
    """Positions of the bits of each band: as many bands as the recall takes."""
    agree = (1 - math.acos(least) / math.pi) ** WIDTH
    count = math.ceil(math.log(1 - RECALL) / math.log1p(-agree))
    draw = np.random.RandomState(SEED)
    return [draw.choice(BITS, WIDTH, replace=False) for _ in range(count)]


def most_bits(least: float) -> int:
    """Bits in which sketches of lines at the threshold differ, at most."""
    share = math.acos(least) / math.pi
    return int(BITS * share + SPREADS * (BITS * share * (1 - share)) ** 0.5) + 1


def series(values: DataFrame, part_days: int) -> DataFrame:
    """``line, part, day, v``: lists of one part of a line's days, in order."""
    return (values.groupBy("line", F.floor(_days() / F.lit(part_days)).cast("bigint").alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct(_days().alias("d"), F.col("value").alias("v"))))
                 .alias("_c"))
            .select("line", "part", F.col("_c.d").alias("day"), F.col("_c.v").alias("v")))


def sketches(parts: DataFrame, part_days: int) -> DataFrame:
    """``line, sketch`` of the ``series``: bits packed, the first bit set."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached: dict[int, np.ndarray] = {}
        for batch in batches:
            sums = []
            for k in range(batch.num_rows):
                part = batch.column("part")[k].as_py()
                if part not in cached:
                    if len(cached) > 8:
                        cached.clear()
                    cached[part] = planes(part, part_days)
                day = batch.column("day")[k].values.to_numpy() - part * part_days
                sums.append(batch.column("v")[k].values.to_numpy().astype(np.float32)
                            @ cached[part][day])
            flat = np.concatenate(sums).astype(np.float64) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("line"), pa.FixedSizeListArray.from_arrays(flat, BITS).cast(
                    pa.list_(pa.float64()))], ["line", "sums"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts_ in batch.column("all").to_pylist():
                total = np.sum(np.array(parts_), axis=0)
                bits = total > 0
                out.append(np.packbits(bits if bits[0] else ~bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(out, pa.binary())],
                                             ["line", "sketch"])

    sums = parts.mapInArrow(project, "line string, sums array<double>")
    return sums.groupBy("line").agg(F.collect_list("sums").alias("all")).mapInArrow(
        pack, "line string, sketch binary")


def candidate_pairs(daily: DataFrame, least: float, log: bool = False,
                    part_days: int = PART_DAYS) -> DataFrame:
    """``a, b``: pairs of lines whose absolute correlation may exceed ``least``.

    A pair at the threshold is found with a probability of 0.99, stronger pairs with more,
    where the two lines have much the same days; constant lines have no direction.  The work
    is lines times bands, and the pairs inside buckets.
    """
    rows = staged(sketches(series(shifted(daily, log), part_days), part_days))
    chosen, most = bands(least), most_bits(least)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(WIDTH)
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("sketch").to_pylist()),
                                               np.uint8).reshape(-1, BITS // 8), axis=1,
                                 bitorder="little")
            for t, at in enumerate(chosen):
                band = bits[:, at]
                band = np.where(band[:, :1] == 1, band, 1 - band)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t * (1 << WIDTH) + band @ weight), batch.column("line"),
                     batch.column("sketch")], ["key", "line", "sketch"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(lines: list, prints: list) -> Iterator[pa.RecordBatch]:
            words = np.frombuffer(b"".join(prints), "<u8").reshape(len(lines), BITS // 64)
            names = np.array(lines, object)
            for i in range(len(lines) - 1):
                apart = np.bitwise_count(words[i + 1:] ^ words[i]).sum(axis=1, dtype=np.int64)
                other = names[i + 1:][np.minimum(apart, BITS - apart) <= most]
                if len(other):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([min(n, names[i]) for n in other], pa.string()),
                         pa.array([max(n, names[i]) for n in other], pa.string())], ["a", "b"])

        current, lines, prints = None, [], []
        for batch in batches:
            for key, line, sketch in zip(*[batch.column(c).to_pylist()
                                           for c in ("key", "line", "sketch")]):
                if key != current:
                    yield from pairs(lines, prints)
                    current, lines, prints = key, [], []
                lines.append(line)
                prints.append(sketch)
        yield from pairs(lines, prints)

    spread = rows.mapInArrow(keyed, "key bigint, line string, sketch binary")
    return spread.repartition("key").sortWithinPartitions("key").mapInArrow(
        close, "a string, b string").distinct()


def corr_of_pairs(daily: DataFrame, pairs: DataFrame, log: bool = False,
                  part_days: int = PART_DAYS) -> DataFrame:
    """``a, b, n, r``: exact correlations of the given pairs and no others.

    A pair takes the two series along, part by part; the work is that of the pairs.
    """
    parts = staged(series(shifted(daily, log), part_days))
    there = parts.select(F.col("line").alias("a"), "part", F.col("day").alias("da"),
                         F.col("v").alias("va"))
    back = parts.select(F.col("line").alias("b"), "part", F.col("day").alias("db"),
                        F.col("v").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                da, va, db, vb = (batch.column(c)[k].values.to_numpy()
                                  for c in ("da", "va", "db", "vb"))
                days, i, j = np.intersect1d(da, db, True, True)
                x = np.stack([va[i], vb[j]])
                n, *sums = _co_moments(x, np.ones_like(x), np.array([0]), np.array([1]))
                out.append((len(days), *[float(s[0, 0]) for s in sums]))
            cols = list(zip(*out)) if out else [()] * (1 + len(SUMS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(cols[0], pa.int64()),
                 *[pa.array(c, pa.float64()) for c in cols[1:]]], ["a", "b", "n", *SUMS])

    sums = pairs.select("a", "b").join(there, "a").join(back, ["b", "part"]).mapInArrow(
        run, "a string, b string, n bigint, " + ", ".join(f"{c} double" for c in SUMS))
    return _r_of_sums(sums.where("n > 0"))


def corr_search(daily: DataFrame, least: float, log: bool = False,
                part_days: int = PART_DAYS) -> DataFrame:
    """``a, b, n, r`` of pairs with an absolute correlation above ``least``: candidates by
    sketches, each confirmed exactly."""
    found = corr_of_pairs(daily, staged(candidate_pairs(daily, least, log, part_days)), log,
                          part_days)
    return found.where(F.abs("r") > least)
