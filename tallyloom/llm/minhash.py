"""MinHash near-duplicates with odd sketches.

A text's set of word shingles has ``SAMPLES`` minimum hashes.  ``BANDS`` bands of ``ROWS``
of them are bucket keys.  All samples are folded into an odd sketch: sample and position
name a bit, and each one flips its bit.  Equal samples cancel in the exclusive or of two
sketches, so its population count estimates how many samples differ; near the top of the
scale that is more precise than counting equal samples in as many bits.

Three steps, each over what the one before left:

1. Sets that share a bucket are compared by sketch, and what is clearly below the threshold
   is let go.  A bucket yields a spanning forest, never its pairs.
2. What the forests reach is a group of candidates.  The sets of a group's texts meet, in
   blocks of a bounded number of shingles, and pairs that the sketches allow and that are
   in different classes are compared as whole sets.
3. Classes are what confirmed links reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_by_value, staged
from .base import text_of
from .components import connected
from .simhash import set_id, shingle_set, thinned

ship_by_value(__name__)

SAMPLES = 384
ROWS, BANDS = 4, 24
SKETCH_BITS = 512
SPREADS = 5.0               # standard deviations that an estimate may lie below the threshold
BUCKET = 4096               # rows of a bucket that one task compares as they are
BLOCK_SHINGLES = 1 << 21    # shingles of a group that one task holds as they are
COPIES = 16
PART = 1 << 20              # hashes multiplied at once
SEED = 42


def constants() -> tuple[np.ndarray, ...]:
    """Odd factors and masks of the sample functions, and factors that name sketch bits."""
    draw = np.random.RandomState(SEED)
    factor = draw.randint(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    mask = draw.randint(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
    salt = draw.randint(0, 1 << 63, SAMPLES, dtype=np.uint64)
    return factor, mask, salt


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def samples(hashes: np.ndarray, factor: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The minimum of every sample function over the set; all ones for an empty set."""
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    step = max(1, PART // SAMPLES)
    for at in range(0, len(short), step):
        part = short[at:at + step, None] ^ mask
        part *= factor
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=0), out=out)
    return out


def band_keys(found: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, its number mixed in."""
    rows = found[:ROWS * BANDS].astype(np.uint64).reshape(BANDS, ROWS)
    key = salt[:BANDS].copy()
    for k in range(ROWS):
        key = stirred(key ^ rows[:, k])
    return key


def odd_sketch(found: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Parity bitmap as 64-bit words: every sample flips the bit that it and its place name."""
    bit = stirred(found.astype(np.uint64) ^ salt) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def most_bits(similar: float) -> int:
    """Odd bits that two sketches differ in at most, for sets at least ``similar``.

    Of the samples, ``d = SAMPLES * (1 - similar)`` differ, with the spread of a binomial.
    Two flips for each leave ``SKETCH_BITS / 2 * (1 - exp(-4 d / SKETCH_BITS))`` odd bits,
    with a spread of their own; the two add up as variances.
    """
    apart = SAMPLES * (1 - similar)
    falls = np.exp(-4 * apart / SKETCH_BITS)
    odd = SKETCH_BITS / 2 * (1 - falls)
    share = odd / SKETCH_BITS
    spread = (4 * falls**2 * apart * similar + SKETCH_BITS * share * (1 - share)) ** 0.5
    return int(odd + SPREADS * spread) + 1


# ---------------------------------------------------------------- signatures


def signatures(docs: DataFrame, *, key: str, text: str, words: int) -> DataFrame:
    """``key, hash, id, n, bands, sketch`` for every row: the text's hash, the name and size
    of its shingle set, band keys and odd sketch."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, mask, salt = constants()
        for batch in batches:
            name, size, bands, sketch = [], [], [], []
            for t in batch.column("text"):
                found = shingle_set(t.as_py(), words)
                least = samples(found, factor, mask)
                name.append(set_id(found))
                size.append(len(found))
                bands.append(band_keys(least, salt).view("<i8"))
                sketch.append(odd_sketch(least, salt).tobytes())
            flat = np.concatenate(bands) if bands else np.zeros(0, "<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("hash"), pa.array(name, pa.int64()),
                 pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, BANDS, np.int32), flat),
                 pa.array(sketch, pa.binary())],
                ["key", "hash", "id", "n", "bands", "sketch"])

    t = text_of(text)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(t).alias("hash"), t.alias("text"))
    return rows.mapInArrow(run, f"key {kind}, hash bigint, id bigint, n bigint, "
                                "bands array<bigint>, sketch binary")


def in_block_pairs(rows: DataFrame, parts) -> DataFrame:
    """Rows of crowded keys in ``parts`` blocks: each pair of blocks is a key, each row is in
    as many keys as there are blocks.  ``side`` tells the blocks of a pair apart."""
    cut = (rows.withColumn("_parts", parts)
           .withColumn("_block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_parts")))
           .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                      F.col("_parts") - 1))))
    return (cut.withColumn("key", F.when(F.col("_parts") > 1, F.xxhash64(
        "key", F.least("_block", "_other"), F.greatest("_block", "_other"))).otherwise(F.col("key")))
        .withColumn("side", F.when(F.col("_block") > F.col("_other"), 1).otherwise(0)))


# ---------------------------------------------------------------- comparison


def spanned(sketch: np.ndarray, side: np.ndarray, most: int,
            sure: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that span the links among rows, of different sides where there are two.

    From a first row on, all rows not reached yet are compared with one reached row at a
    time: in a group of copies every row is compared once.  ``sure(i, rows)`` confirms which
    of the rows that the sketches allow are links.
    """
    rest, out, two = np.arange(len(sketch)), [], bool(side.any())
    while len(rest):
        ahead, rest = [rest[0]], rest[1:]
        while ahead and len(rest):
            i = ahead.pop()
            close = np.bitwise_count(sketch[rest] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= most
            if two:
                close &= side[rest] != side[i]
            at = np.flatnonzero(close)
            if len(at):
                at = at[sure(i, rest[at])]
            if len(at):
                found = rest[at]
                out += [(int(i), int(j)) for j in found]
                ahead += found.tolist()
                rest = np.delete(rest, at)
    return out


def sketch_links(rows: DataFrame, most: int, bucket: int) -> DataFrame:
    """Edges ``u, v`` that span the sets of ``rows(id, bands, sketch)`` whose sketches agree
    inside a bucket."""
    spread = rows.select("id", F.explode("bands").alias("key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    # sketches travel only to buckets with company
    met = spread.join(sizes, "key").join(rows.select("id", "sketch"), "id")
    half = F.lit(max(1, bucket // 2))
    parts = F.when(F.col("rows") > bucket, F.ceil(F.col("rows") / half)).otherwise(1).cast("bigint")
    ready = in_block_pairs(met, parts).select("key", "side", "id", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(ids: list, side: list, sketch: list) -> pa.RecordBatch:
            pairs = spanned(np.frombuffer(b"".join(sketch), "<u8").reshape(len(ids), -1),
                            np.array(side), most, lambda i, js: np.ones(len(js), bool))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in pairs], pa.int64()),
                 pa.array([ids[j] for _, j in pairs], pa.int64())], ["u", "v"])

        current, held = None, ([], [], [])
        for batch in batches:
            for key, *row in zip(*[batch.column(c).to_pylist()
                                   for c in ("key", "side", "id", "sketch")]):
                if key != current:
                    if len(held[0]) > 1:
                        yield edges(held[1], held[0], held[2])
                    current, held = key, ([], [], [])
                for column, value in zip(held, row):
                    column.append(value)
        if len(held[0]) > 1:
            yield edges(held[1], held[0], held[2])

    return ready.repartition("key").sortWithinPartitions("key").mapInArrow(
        run, "u bigint, v bigint")


def set_links(rows: DataFrame, *, words: int, most: int, similar: int) -> DataFrame:
    """Edges ``u, v`` between ids whose whole sets are at least ``similar`` per cent alike,
    spanning all such links among the rows of a key; ``rows`` has key, side, id, sketch, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(held: dict) -> pa.RecordBatch:
            ids, sets = list(held), [h[0] for h in held.values()]

            def sure(i: int, js: np.ndarray) -> np.ndarray:
                a, out = sets[i], np.zeros(len(js), bool)
                for k, j in enumerate(js.tolist()):
                    b = sets[j]
                    few, many = (a, b) if len(a) <= len(b) else (b, a)
                    if 100 * len(few) < similar * len(many) or not len(few):
                        continue
                    at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                    both = int((many[at] == few).sum())
                    out[k] = 100 * both >= similar * (len(a) + len(b) - both)
                return out

            pairs = spanned(np.frombuffer(b"".join(h[1] for h in held.values()), "<u8").reshape(
                len(ids), -1), np.array([h[2] for h in held.values()]), most, sure)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in pairs], pa.int64()),
                 pa.array([ids[j] for _, j in pairs], pa.int64())], ["u", "v"])

        current, held = None, {}
        for batch in batches:
            keys, side, name, sketch = [batch.column(c).to_pylist()
                                        for c in ("key", "side", "id", "sketch")]
            for k in range(batch.num_rows):
                if keys[k] != current:
                    if len(held) > 1:
                        yield edges(held)
                    current, held = keys[k], {}
                if name[k] not in held:
                    found = shingle_set(batch.column("text")[k].as_py(), words)
                    if set_id(found) == name[k]:        # not another text of the same hash
                        held[name[k]] = found, sketch[k], side[k]
        if len(held) > 1:
            yield edges(held)

    ready = rows.select("key", "side", "id", "sketch", "text")
    return ready.repartition("key").sortWithinPartitions("key").mapInArrow(
        run, "u bigint, v bigint")


# ---------------------------------------------------------------- operator


def near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 2,
                similar: int = 80, bucket: int = BUCKET,
                block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    A row's set holds the distinct ``words``-word shingles of its lower-cased (A-Z) text,
    the whole sequence if it has fewer words.  Rows link at ``similar`` per cent of common
    among all shingles; a class is all that links reach, named by its smallest key, and
    ``kept`` is the row of that name.  Links are confirmed on whole sets.  A link at exactly
    80 per cent is missed by all bands with a probability of 3 in a million, by the sketch
    bound with fewer; both fall fast above.

    Texts without words, null texts among them, have empty sets and link with nothing.  A
    null key takes part in links but names a class only if it has no other; equal keys of
    different texts are rows of their own, all kept or all not.  Other columns are not
    looked at; an empty table gives an empty result.
    """
    most = most_bits(similar / 100)
    marked = staged(signatures(docs, key=key, text=text, words=words))
    full = marked.where("n > 0")
    # one row per set, and where to find a text of it
    sets = staged(full.groupBy("id").agg(
        F.min("key").alias("least"), F.any_value("n").alias("n"),
        F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"),
        F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("at")))
    roots = cut_lineage(connected(thinned(sketch_links(sets, most, bucket))))
    members = roots.select(F.col("node").alias("id"), F.col("root").alias("key")).unionByName(
        roots.select(F.col("root").alias("id"), F.col("root").alias("key")).distinct())
    wanted = members.join(sets.select("id", "n", "sketch", F.col("at.key").alias("_at"),
                                      F.col("at.hash").alias("_hash")), "id")
    sizes = wanted.groupBy("key").agg(F.sum("n").alias("total"))
    wanted = wanted.join(sizes, "key")
    t = text_of(text)
    texts = docs.select(F.col(key).alias("_key"), t.alias("text"), F.xxhash64(t).alias("_own"))
    rows = wanted.join(texts, (F.col("_own") == F.col("_hash"))
                       & F.col("_key").eqNullSafe(F.col("_at")))
    half = F.lit(max(1, block_shingles // 2))
    parts = F.when(F.col("total") > block_shingles,
                   F.ceil(F.col("total") / half)).otherwise(1).cast("bigint")
    found = cut_lineage(connected(set_links(
        in_block_pairs(rows, parts), words=words, most=most, similar=similar)))
    linked = found.select(F.col("node").alias("id"), "root").unionByName(
        found.select(F.col("root").alias("id"), "root").distinct())
    best = linked.join(sets.select("id", "least"), "id").groupBy("root").agg(
        F.min("least").alias("name"))
    # a class may be most of the table: its name goes out in copies
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    by_set = linked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(COPIES)).cast("int")).join(
        best, ["root", "salt"]).select("id", "name")
    names = sets.join(by_set, "id", "left").select("id", F.coalesce("name", "least").alias("name"))
    out = marked.select("key", "id", "n").join(names, "id", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("key")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
