"""Records of delimited text, read from splits of any size.

Lines are read by splits, as any text.  Inside a split, a line whose quote stays open is
joined with the lines after it, until a quote closes and the whole has the wanted number of
fields; what does not come out so within the allowed lines is a damaged record, and the
lines after it are read anew.  So one stray quote costs its own record and nothing else.
A record across two splits is put together from the last lines of one and the first of the
next.  Lines without open quotes are judged by array functions alone, whole batches at once.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_by_value, staged

ship_by_value(__name__)

BOM = "\ufeff"
FEW, MANY, OPEN = "too few fields", "too many fields", "open quote"
COLUMNS = ("file", "source_file", "block", "line", "record", "fields", "seam")
SCHEMA = ("file string, source_file string, block bigint, line bigint, record string, "
          "fields int, seam string")


def fields_of(record: str, strict: bool = False) -> int:
    """Number of fields; -1 if a quote stays open.  Text after a closing quote belongs to the
    field, or counts as an open quote too where ``strict``."""
    csv.field_size_limit(1 << 30)
    try:
        return len(next(csv.reader(io.StringIO(record, newline=""), strict=True), []))
    except csv.Error as error:
        if strict or "unexpected end" in str(error):
            return -1
    return len(next(csv.reader(io.StringIO(record, newline="")), []))


class Split:
    """One split, fed with its lines batch by batch.

    Only lines with an odd number of quotes, and the lines from such a one to the next, are
    looked at one by one; all others are judged by array functions and leave in whole
    batches.  ``held`` are lines that wait for a closing quote, at most ``most`` + 1 of them,
    or the lines of the head while the first stray quote of the split is not found.
    """

    def __init__(self, width: int, most_lines: int, head: bool):
        self.width, self.most, self.head = width, most_lines, head
        self.held: pa.Table | None = None
        self.at = 0                             # line of the first of the held ones

    def feed(self, rows: pa.Table, last: bool) -> pa.Table | None:
        """Records of the held lines and of ``rows(value, file, source_file, block)``;
        None as long as the head is open."""
        if self.held is not None:
            rows = pa.concat_tables([self.held, rows])
        n, value = rows.num_rows, rows.column("value").combine_chunks()
        quotes = pc.count_substring(value, '"').to_numpy()
        fields = pc.count_substring(value, ",").to_numpy() + 1
        odds = np.flatnonzero(quotes % 2).tolist()
        keep, whole = np.ones(n, bool), {}      # lines that are records; longer records
        stray, end = None, n                    # first stray quote; from where lines wait
        p = 0
        while p < len(odds):
            k = odds[p]
            p += 1
            fields[k] = fields_of(value[k].as_py())
            if fields[k] == -1:
                if p == len(odds):
                    if n - 1 - k < self.most:   # a quote may still close
                        end = k
                        break
                elif odds[p] - k <= self.most:
                    text = "\n".join(value.slice(k, odds[p] + 1 - k).to_pylist())
                    if fields_of(text, True) == self.width:
                        whole[k], fields[k] = text, self.width
                        keep[k + 1:odds[p] + 1] = False
                        p += 1
                        continue
            if stray is None:
                stray = k
        head = 0
        if self.head:
            # lines up to the first stray quote, unless a longer record or more than the
            # allowed lines come before
            if stray is not None and stray < min(whole, default=n):
                head = stray + 1 if stray <= self.most else 0
            elif not whole and end <= self.most and not last:
                self.held = rows
                return None
            self.head = False
        stop = n if last else end
        self.held = rows.slice(stop) if stop < n else None
        for k in np.flatnonzero(keep & (quotes > 0) & (quotes % 2 == 0)).tolist():
            fields[k] = fields_of(value[k].as_py())
        if whole:
            longer = np.zeros(n, bool)
            longer[list(whole)] = True
            value = pc.replace_with_mask(value, pa.array(longer),
                                         pa.array(list(whole.values()), value.type))
        seam = (pa.array(["head"] * head + [None] * (end - head) + ["tail"] * (n - end),
                         pa.string()) if head or end < n else pa.nulls(n, pa.string()))
        line = pa.array(np.arange(self.at, self.at + n))
        self.at += stop
        out = pa.table([rows.column("file"), rows.column("source_file"), rows.column("block"),
                        line, value, pa.array(fields, pa.int32()), seam], list(COLUMNS))
        return out.slice(0, stop).filter(pa.array(keep[:stop]))


def in_splits(lines: DataFrame, width: int, header: list[str] | None, most_lines: int
              ) -> DataFrame:
    """Records of every split; lines at its ends that may belong together carry ``seam``."""
    header = header and [header[0].lstrip(BOM), *header[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = place = ahead = None            # ahead: the rows that come next

        def fed(last: bool) -> list[pa.RecordBatch]:
            out = split.feed(ahead, last)
            return [] if out is None else out.to_batches()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            file, starts = batch.column("file"), batch.column("block").to_numpy()
            same = pc.equal(file.slice(1), file.slice(0, max(0, len(file) - 1))).to_numpy(
                zero_copy_only=False) & (starts[1:] == starts[:-1])
            edges = [0, *(np.flatnonzero(~same) + 1).tolist(), len(file)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                here = file[a].as_py(), int(starts[a])
                if ahead is not None:
                    yield from fed(here != place)
                if here != place:
                    split, place = Split(width, most_lines, here[1] != 0), here
                    if here[1] == 0:            # the header of the file
                        found = next(csv.reader([batch.column("value")[a].as_py()]), [])
                        if header is not None and found != header:
                            raise ValueError(f"columns of {here[0]}: {found}, wanted: {header}")
                        a, split.at = a + 1, 1
                ahead = rows.slice(a, b - a)
        if ahead is not None:
            yield from fed(True)

    return lines.mapInArrow(run, SCHEMA)


def records(lines: DataFrame, width: int, header: list[str] | None, most_lines: int
            ) -> DataFrame:
    """``file, source_file, block, line, record, reason`` of the ``lines(value, file,
    source_file, block)`` of delimited files.

    ``reason`` is null for records of ``width`` fields.  ``line`` counts lines of a block.
    The first line of a file is its header, checked unless ``header`` is None.  Blank lines
    between records are left out.  The lines are read once, and what the splits hold is
    staged: the seams, with ``most_lines`` lines at most on either side, and the records of
    whatever kind are then scans.
    """
    found = staged(in_splits(lines, width, header, most_lines))
    ends = found.where("seam IS NOT NULL").groupBy("file", "source_file", "block", "seam").agg(
        F.array_sort(F.collect_list(F.struct("line", "record", "fields"))).alias("part"))
    # the splits that have an end of either kind, next to each other
    blocks = found.select("file", "block").distinct().select(
        "file", "block", F.lead("block").over(
            Window.partitionBy("file").orderBy("block")).alias("next"))
    tails = ends.where("seam = 'tail'").join(blocks, ["file", "block"])
    heads = ends.where("seam = 'head'").select(
        "file", F.col("block").alias("next"), F.col("part").alias("head"))
    met = tails.withColumnRenamed("part", "tail").join(heads, ["file", "next"], "full").select(
        "file", "source_file", F.coalesce("tail", F.array()).alias("tail"),
        F.coalesce("head", F.array()).alias("head"), "block", "next")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                whole = "\n".join(p["record"] for p in r["tail"] + r["head"])
                name = r["file"].rsplit("/", 1)[-1]
                if r["tail"] and r["head"] and fields_of(whole, True) == width:
                    out.append((r["file"], name, r["block"], r["tail"][0]["line"], whole, width,
                                None))
                    continue
                for block, part in ((r["block"], r["tail"]), (r["next"], r["head"])):
                    out += [(r["file"], name, block, p["line"], p["record"], p["fields"], None)
                            for p in part]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(),
                     pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)],
                list(COLUMNS))

    every = found.where("seam IS NULL").unionByName(met.mapInArrow(resolve, SCHEMA))
    reason = (F.when(F.col("fields") < 0, OPEN).when(F.col("fields") < width, FEW)
              .when(F.col("fields") > width, MANY))
    return every.where(F.trim("record") != "").select(
        "file", "source_file", "block", "line", "record", reason.alias("reason"))
