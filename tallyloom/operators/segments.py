"""Linear filling along an order that no task sees as a whole.

Rows are put in order once, by ranges of (series, day, number), and cut into segments: rows
of one series that follow each other in one range, at most ``segment_rows`` of them.  A
task fills what it can inside a segment and returns two kinds of rows: empty cells that may
be filled, and one summary per segment.  Neighbours across borders come from a window over
the summaries, of which a series has one per range or ``segment_rows`` rows.  Cells too far
behind a known value are never returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship_by_value, staged

ship_by_value(__name__)

COUNTS = ("_part", "_seg", "_cell", "n", "lead", "tail", "step", "ahead")
VALUES = ("fv", "lv", "before", "after")


def scanned(known: np.ndarray, value: np.ndarray, limit: int) -> tuple[np.ndarray, dict, dict]:
    """Cells of a segment that may be filled, what is known of them, and the summary.

    ``step``: rows since the last known value, or since the start of the segment where
    there is none (``before`` is null); ``ahead``: rows up to the next known value, or up to
    and with the end of the segment (``after`` is null).
    """
    n, at = len(known), np.arange(len(known))
    last = np.maximum.accumulate(np.where(known, at, -1))
    following = np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1]
    cells = np.flatnonzero(~known & (at - last <= limit))
    back, on = last[cells], following[cells]
    about = {"step": cells - back, "ahead": on - cells,
             "before": pa.array(value[np.maximum(back, 0)], pa.float64(), mask=back < 0),
             "after": pa.array(value[np.minimum(on, n - 1)], pa.float64(), mask=on == n)}
    some = bool(known.any())
    first, final = int(following[0]), int(last[-1])
    summary = {"n": n, "lead": first if some else None, "tail": n - 1 - final if some else None,
               "fv": float(value[first]) if some else None,
               "lv": float(value[final]) if some else None}
    return cells, about, summary


def filled_cells(rows: DataFrame, limit: int, segment_rows: int) -> DataFrame:
    """``series, day, seq, filled`` of the empty cells of ``series, day, seq, value`` that
    get a value."""
    fields = {f.name: f for f in rows.schema.fields}
    out = T.StructType([T.StructField(c, fields[c].dataType) for c in ("series", "day", "seq")]
                       + [T.StructField(c, T.LongType()) for c in COUNTS]
                       + [T.StructField(c, T.DoubleType()) for c in VALUES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, 0

        def segment(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            value = table.column("value").combine_chunks()
            known = value.is_valid().to_numpy(zero_copy_only=False)
            plain = value.fill_null(0.0).to_numpy(zero_copy_only=False)
            cells, about, summary = scanned(known, plain, limit)
            m = len(cells)
            take = pa.array(np.r_[cells, 0], pa.int64())
            columns = {c: table.column(c).combine_chunks().take(take)
                       for c in ("series", "day", "seq")}
            columns |= {"_part": table.column("_part").combine_chunks().take(take),
                        "_seg": pa.array(np.full(m + 1, number), pa.int64()),
                        "_cell": pa.array(np.r_[np.ones(m), 0], pa.int64())}
            for c in ("step", "ahead"):
                columns[c] = pa.array([*about[c].tolist(), None], pa.int64())
            for c in ("before", "after"):
                columns[c] = pa.concat_arrays([about[c], pa.nulls(1, pa.float64())])
            for c in ("n", "lead", "tail", "fv", "lv"):
                kind = pa.float64() if c in VALUES else pa.int64()
                columns[c] = pa.concat_arrays([pa.nulls(m, kind), pa.array([summary[c]], kind)])
            number += 1
            names = ["series", "day", "seq", *COUNTS, *VALUES]
            return pa.RecordBatch.from_arrays([columns[c] for c in names], names)

        for batch in batches:
            series, start = batch.column("series"), 0
            change = pc.not_equal(series.slice(1), series.slice(0, max(len(series) - 1, 0)))
            ends = (np.flatnonzero(change.to_numpy(zero_copy_only=False)) + 1).tolist()
            for end in [*ends, batch.num_rows]:
                while start < end:
                    if held and (size >= segment_rows
                                 or held[-1].column("series")[0] != series[start]):
                        yield segment(pa.Table.from_batches(held))
                        held, size = [], 0
                    part = batch.slice(start, min(end - start, segment_rows - size))
                    held.append(part)
                    size += part.num_rows
                    start += part.num_rows
        if held:
            yield segment(pa.Table.from_batches(held))

    order = ["series", "day", "seq"]
    # written first: the ranges are found in a pass of their own
    ranges = (staged(rows.where(F.col("series").isNotNull())).repartitionByRange(*order)
              .sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id().cast("bigint")))
    seen = staged(ranges.mapInArrow(run, out))
    place = ["series", "_part", "_seg"]
    ahead = Window.partitionBy("series").orderBy("_part", "_seg")
    back = Window.partitionBy("series").orderBy(F.desc("_part"), F.desc("_seg"))

    def earlier(window):
        return window.rowsBetween(Window.unboundedPreceding, -1)

    some = F.col("fv").isNotNull()
    ends = seen.where("_cell = 0").select(*place, "n", "lead", "tail", "fv", "lv").withColumns({
        "_to": F.sum("n").over(ahead)})
    start = F.col("_to") - F.col("n")
    ends = ends.withColumns({
        "_before": F.last("lv", ignorenulls=True).over(earlier(ahead)),
        "_gap": start - F.last(F.when(some, F.col("_to") - F.col("tail")),
                               ignorenulls=True).over(earlier(ahead)),
        "_after": F.last("fv", ignorenulls=True).over(earlier(back)),
        "_rest": F.last(F.when(some, start + F.col("lead")),
                        ignorenulls=True).over(earlier(back)) - F.col("_to")})
    cells = seen.where("_cell = 1").select(*order, "_part", "_seg", "step", "ahead", "before",
                                           "after")
    cells = cells.join(ends.select(*place, "_before", "_gap", "_after", "_rest"), place)
    inside = F.col("before").isNotNull()
    step = F.col("step") + F.when(inside, 0).otherwise(F.col("_gap"))
    value = F.coalesce("before", "_before")
    after = F.coalesce("after", "_after", value)
    ahead_ = F.col("ahead") + F.when(F.col("after").isNotNull(), 0).otherwise(
        F.coalesce("_rest", F.lit(0)))
    cells = cells.where(value.isNotNull() & (step <= limit))
    return cells.select(*order, (value + (after - value) * step / (step + ahead_)).alias("filled"))
