"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has one or more 64-bit lanes; a bit is set if it is set in over half of the
text's shingle hashes.  Equal fingerprints are one row from the start.  Candidates share a
key: the fingerprint under a mask.  Inside a bucket of equal keys, rows are compared with
the row ``d`` places on, for each ``d`` in turn and for all rows of a chunk at once: bit
planes lie vertically (bit k of 64 rows in one word), differences are counted in
carry-save counters, one word operation for 64 pairs, and words whose pairs all exceed
the radius are abandoned.  What leaves a worker is a spanning forest, never all pairs.

Two families of masks:

* ``pigeonhole``: radius 3 over 64 bits.  Of six blocks of bits at least three agree, so
  one of twenty masks finds every link.
* ``bands``: for wide fingerprints and large radii, 14-bit bands; a link is found if one
  band agrees.

``keep_one`` takes such links for candidates only: the shingle sets of each group of
candidates are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_by_value, staged
from .base import small, text_of, unused
from .components import connected

ship_by_value(__name__)

SEED = 42
HOT = 4096                  # rows of a bucket that one task compares as they are
GROUP = 1024                # candidates of a group that one task compares exactly
CHUNK = 1 << 16             # rows compared at once, at least; whole buckets
EDGES = 1 << 17             # edges that one task thins out, and tasks that do so at least
THIN = 8
EVERY = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# ---------------------------------------------------------------- fingerprints


def stirred(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The hashes for a further lane: another 64 bits of each, by a mixing function."""
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 hashes with seed 42 of the text's shingles, repeats included; none for a text
    without words."""
    found = text.encode().translate(LOWER).split()
    if not found:
        return
    words = min(words, len(found))
    joined = b" ".join(found)
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(found) - words + 1, CHUNK):
        spans = zip(starts[at:at + CHUNK], ends[at + words - 1:at + CHUNK + words - 1])
        yield np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes in order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingles(text, words)]))


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def majority(parts: Iterable[np.ndarray], lanes: int) -> list[int]:
    """Lanes as signed 64-bit integers; zero without hashes."""
    n, counts = 0, np.zeros((lanes, 64), np.int64)
    for hashes in parts:
        n += len(hashes)
        for lane in range(lanes):
            bits = np.unpackbits(stirred(hashes, lane).view(np.uint8).reshape(-1, 8), axis=1,
                                 bitorder="little")
            counts[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def fingerprint(text: str, words: int = 3, lanes: int = 1) -> list[int]:
    """Lanes as signed 64-bit integers; zero for a text without words.

    Shingles are space-joined, repeats count, and fewer words than a shingle has are one
    shingle.  Hashes are XXH64 with seed 42; further lanes mix them anew.
    """
    return majority(shingles(text, words), lanes)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3,
                 lanes: int = 1) -> DataFrame:
    """``key, f0, f1, ...`` for every row; a null text is an empty one."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words, lanes)
                              for t in batch.column("text")], "<i8").reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(found[:, k]) for k in range(lanes)]],
                ["key", *[f"f{k}" for k in range(lanes)]])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    fields = ", ".join(f"f{k} bigint" for k in range(lanes))
    return rows.mapInArrow(run, f"key {kind}, {fields}").withColumnRenamed("key", key)


# ---------------------------------------------------------------- keys


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cut_mask(bits: Sequence[int], blocks: int = 6, agree: int = 3) -> list[int]:
    """Masks over all choices of ``agree`` of ``blocks`` nearly equal blocks of ``bits``."""
    size = [len(bits) // blocks + (k < len(bits) % blocks) for k in range(blocks)]
    ends = list(accumulate(size))
    parts = [sum(1 << b for b in bits[e - s:e]) for s, e in zip(size, ends)]
    return [sum(parts[k] for k in chosen) for chosen in combinations(range(blocks), agree)]


def pigeonhole() -> list[tuple[int, ...]]:
    return [(signed(m),) for m in cut_mask(range(64))]


def bands(lanes: int, width: int = 14, deals: int = 5) -> list[tuple[int, ...]]:
    """Bands of ``width`` bits over all lanes: all bits, dealt anew ``deals`` times."""
    total, out = 64 * lanes, []
    for deal in range(deals):
        order = np.random.RandomState(SEED + deal).permutation(total).tolist()
        for a in range(0, total - width + 1, width):
            out.append(tuple(signed(sum(1 << (b % 64) for b in order[a:a + width]
                                        if b // 64 == lane)) for lane in range(lanes)))
    return out


def keyed(rows: DataFrame, masks: Sequence[tuple[int, ...]]) -> DataFrame:
    """One row per mask: its number ``t`` and ``key``, a hash of the masked fingerprint."""
    def key(t: int, mask: tuple[int, ...]) -> Column:
        used = [F.col(f"f{k}").bitwiseAND(F.lit(m)) for k, m in enumerate(mask) if m]
        return F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *used).alias("key"))

    return rows.select("*", F.inline(F.array(*[key(t, m) for t, m in enumerate(masks)])))


def split_exactly(rows: DataFrame, masks: Sequence[tuple[int, ...]]) -> DataFrame:
    """Finer keys for crowded buckets of the pigeonhole masks.

    Inside a bucket only the other bits differ, by three at most, so the same argument
    holds for six blocks of those: twenty finer keys find every link.  Some 16 bits are
    left free then, and a bucket has at most 65,536 fingerprints, however large the table.
    """
    finer = F.array(*[F.array(*[F.lit(signed(f)) for f in cut_mask(
        [b for b in range(64) if not (m >> b) & 1])]) for (m,) in masks])
    sub = F.transform(F.get(finer, F.col("t")), lambda f: F.xxhash64(
        F.col("key"), f, F.col("f0").bitwiseAND(f)))
    return rows.withColumn("key", F.explode(sub)).withColumn("side", F.lit(0))


def split_in_pairs(rows: DataFrame, limit: int) -> DataFrame:
    """Crowded buckets in blocks: each pair of blocks is a bucket, each row in as many
    buckets as there are blocks.  ``n`` is the size of the row's bucket."""
    parts = F.ceil(F.col("n") / F.lit(limit // 2)).cast("bigint")
    cut = rows.withColumn("_block", F.pmod(F.xxhash64("id", F.lit(7)), parts)).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return cut.withColumn("key", F.xxhash64(
        "key", F.least("_block", "_other"), F.greatest("_block", "_other"))).withColumn(
        "side", F.when(F.col("_block") > F.col("_other"), 1).otherwise(0))


# ---------------------------------------------------------------- comparison


def planes(lanes: list[np.ndarray]) -> np.ndarray:
    """Bit planes as bytes, one row per bit: ``(64 * lanes, n)``."""
    return np.concatenate([np.ascontiguousarray(np.unpackbits(
        f.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)
        for f in lanes])


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of single bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    if pad:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], pad), np.uint8)], -1)
    return np.ascontiguousarray(packed).view("<u8")


def within(left: np.ndarray, right: np.ndarray, open_: np.ndarray, radius: int) -> np.ndarray:
    """Which of the ``open_`` pairs differ in at most ``radius`` planes (all packed).

    The carry-save counters start so that a pair runs over with the bit after the last one
    allowed.  Every eight planes, words without an open pair are abandoned.
    """
    digits = max(1, radius.bit_length())
    start = (1 << digits) - 1 - radius
    at = np.flatnonzero(open_)
    over = ~open_[at]
    count = [np.full(len(at), EVERY if start >> k & 1 else 0, np.uint64)
             for k in range(digits)]
    for b in range(len(left)):
        carry = left[b, at] ^ right[b, at]
        for c in count:
            ahead = c & carry
            c ^= carry
            carry = ahead
        over |= carry
        if b % 8 == 7:
            alive = over != EVERY
            if not alive.all():
                at, over = at[alive], over[alive]
                count = [c[alive] for c in count]
                if not len(at):
                    break
    found = np.zeros_like(open_)
    found[at] = ~over
    return found


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the classes of ``i`` and ``j``; a class is named by its smallest member."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def forest(bucket: np.ndarray, side: np.ndarray, lanes: list[np.ndarray],
           radius: int) -> np.ndarray:
    """Root of each row; rows are sorted by bucket.  Rows of one bucket are compared, in
    buckets with two sides only those of different sides."""
    n = len(bucket)
    root = np.arange(n)
    bits = planes(lanes)
    whole = words_of(bits)
    first = np.r_[True, bucket[1:] != bucket[:-1]]
    run = np.cumsum(first) - 1
    mixed = np.bincount(run, side)[run] > 0
    longest = int(np.bincount(run).max()) if n else 0
    for d in range(1, longest):
        same = (bucket[d:] == bucket[:-d]) & (~mixed[d:] | (side[d:] != side[:-d]))
        if not same.any():
            continue
        open_ = words_of(same)
        ahead = words_of(bits[:, d:]) if d % 64 else whole[:, d // 64:]
        hit = within(whole[:, :len(open_)], ahead[:, :len(open_)], open_, radius)
        if hit.any():
            i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            root = merge(root, i, i + d)
    return root


def links(rows: DataFrame, masks: Sequence[tuple[int, ...]], radius: int, lanes: int,
          exact: bool, hot: int = HOT) -> DataFrame:
    """Edges ``u, v`` between fingerprint ids that span the links found."""
    names = [f"f{k}" for k in range(lanes)]
    spread = keyed(rows, masks)
    crowded = small(spread.groupBy("t", "key").agg(F.count("*").alias("n")).where(
        F.col("n") > hot))
    cols = ["t", "key", "id", *names]
    if crowded.isEmpty():
        parts = spread.select(*cols, F.lit(0).alias("side"))
    else:
        calm = spread.join(crowded, ["t", "key"], "left_anti").withColumn("side", F.lit(0))
        busy = spread.join(crowded, ["t", "key"])
        busy = split_exactly(busy, masks) if exact else split_in_pairs(busy, hot)
        parts = calm.select(*cols, "side").unionByName(busy.select(*cols, "side"))
    parts = parts.repartition("key", "t").sortWithinPartitions("key", "t", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table) -> pa.RecordBatch:
            col = {c: table.column(c).to_numpy() for c in table.column_names}
            bucket = np.cumsum(np.r_[0, (np.diff(col["key"]) != 0) | (np.diff(col["t"]) != 0)]
                               ) if len(col["key"]) else np.zeros(0, np.int64)
            root = forest(bucket, col["side"], [col[f] for f in names], radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            edge = np.unique(np.stack([col["id"][moved], col["id"][root[moved]]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])],
                                              ["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))      # the last bucket may go on
            if cut:
                yield compared(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield compared(pa.Table.from_batches(held))

    return parts.mapInArrow(run, "u bigint, v bigint").distinct()


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: a spanning forest of each task's share, at
    most one edge per task and node.  Every band of a large group brings a star of its own;
    together they are many times its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            ends = np.stack([table.column(c).to_numpy() for c in ("u", "v")])
            ids, at = np.unique(ends, return_inverse=True)
            at = at.reshape(ends.shape)
            root = merge(np.arange(len(ids)), at[0], at[1])
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])],
                                             ["u", "v"])

    edges = staged(edges)
    parts = max(THIN, -(-edges.count() // EDGES))
    return edges.repartition(parts).mapInArrow(run, "u bigint, v bigint").distinct()


# ---------------------------------------------------------------- operator


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3,
            lanes: int = 1, radius: int = 3, hot: int = HOT) -> DataFrame:
    """``key, f0, ..., component_id`` for every row; a class is all that links reach, and
    is named by its smallest key.

    With one lane and radius 3 no link is lost.  With more lanes, 14-bit bands find a link
    with the probability that one of them agrees.  Rows without words have the zero
    fingerprint and link like any other.  Null keys take part but name a class only if it
    has no other; repeated rows are one fingerprint; other columns are not looked at; an
    empty table gives an empty result.
    """
    exact = lanes == 1 and radius <= 3
    names = [f"f{k}" for k in range(lanes)]
    marked = staged(fingerprints(docs, key=key, text=text, words=words, lanes=lanes))
    # one row per fingerprint, named by a number of its own
    own = F.col("f0") if lanes == 1 else F.xxhash64(*names)
    distinct = staged(marked.groupBy(*names).agg(F.min(key).alias("least"))
                      .withColumn("id", own))
    edges = links(distinct.select("id", *names), pigeonhole() if exact else bands(lanes),
                  radius, lanes, exact, hot)
    roots = cut_lineage(connected(edges))
    named = distinct.join(roots, F.col("id") == F.col("node"), "left").select(
        *names, "least", F.coalesce("root", "id").alias("root"))
    # single fingerprints meet no one: sums by root are as many as the fingerprints
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(best, "root").select(*names, "component_id")
    return marked.join(by_print, names).select(key, *names, "component_id")


def set_prints(docs: DataFrame, *, key: str, text: str, words: int, lanes: int) -> DataFrame:
    """``key, hash, id, f0, f1, ...`` for every row: the text's hash, the name of its
    shingle set and the fingerprint of that set, in which repeats do not count."""
    kind = dict(docs.dtypes)[key]

    def named(found: np.ndarray) -> tuple[int, list[int]]:
        return set_id(found), majority([found], lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch's sets together would be larger than its texts
            both = [named(shingle_set(t.as_py(), words)) for t in batch.column("text")]
            found = np.array([f for _, f in both], "<i8").reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("hash"),
                 pa.array([i for i, _ in both], pa.int64()),
                 *[pa.array(found[:, k]) for k in range(lanes)]],
                ["key", "hash", "id", *[f"f{k}" for k in range(lanes)]])

    t = text_of(text)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(t).alias("hash"), t.alias("text"))
    fields = ", ".join(f"f{k} bigint" for k in range(lanes))
    return rows.mapInArrow(run, f"key {kind}, hash bigint, id bigint, {fields}")


def confirmed(sets: Sequence[np.ndarray], prints: np.ndarray, side: np.ndarray, radius: int,
              similar: float) -> list[tuple[int, int]]:
    """Pairs at least ``similar`` as sets that span all such pairs whose fingerprints differ
    in at most ``radius`` bits; with two sides, of pairs of different sides."""
    root, out = np.arange(len(sets)), []
    mixed = bool(side.any())
    for i, a in enumerate(sets):
        near = np.bitwise_count(prints[i + 1:] ^ prints[i]).sum(axis=1, dtype=np.int64) <= radius
        near &= root[i + 1:] != root[i]
        if mixed:
            near &= side[i + 1:] != side[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            b = sets[j]
            if root[i] == root[j] or min(len(a), len(b)) < similar * max(len(a), len(b)) - 1:
                continue
            few, many = (a, b) if len(a) <= len(b) else (b, a)
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            both = int((many[at] == few).sum()) if len(few) else 0
            if both >= similar * (len(a) + len(b) - both) - 1e-9:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def exact_links(rows: DataFrame, *, words: int, lanes: int, radius: int, similar: float
                ) -> DataFrame:
    """Edges ``u, v`` between ids, confirmed by their texts; ``rows`` has key, side, id, the
    fingerprint and text, and rows of one key are compared."""
    names = [f"f{k}" for k in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(held: dict) -> pa.RecordBatch:
            ids = list(held)
            pairs = confirmed([h[0] for h in held.values()],
                              np.array([h[1] for h in held.values()], "<i8").view("<u8"),
                              np.array([h[2] for h in held.values()]), radius, similar)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in pairs], pa.int64()),
                 pa.array([ids[j] for _, j in pairs], pa.int64())], ["u", "v"])

        held, current = {}, None
        for batch in batches:
            key, side, id_, *prints = [batch.column(c).to_pylist()
                                       for c in ("key", "side", "id", *names)]
            for k in range(batch.num_rows):
                if key[k] != current:
                    if len(held) > 1:
                        yield edges(held)
                    held, current = {}, key[k]
                if id_[k] in held:
                    continue
                found = shingle_set(batch.column("text")[k].as_py(), words)
                if set_id(found) == id_[k]:     # not another text of the same hash
                    held[id_[k]] = found, [p[k] for p in prints], side[k]
        if len(held) > 1:
            yield edges(held)

    parts = rows.select("key", "side", "id", *names, "text")
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(
        run, "u bigint, v bigint").distinct()


def similar_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                    words: int = 5, lanes: int = 4, radius: int = 60, similar: float = 0.8,
                    hot: int = HOT, group: int = GROUP) -> DataFrame:
    """``key, component_id`` for every row: classes of texts that links reach, a link being
    a similarity of the shingle sets (common by all) of at least ``similar``.

    Fingerprints of the sets propose: what their links reach is a group of candidates.
    Inside a group, texts are compared by their whole sets, except pairs beyond the radius
    and pairs already in one class.  Groups above ``group`` go to tasks as pairs of blocks.
    """
    names = [f"f{k}" for k in range(lanes)]
    marked = staged(set_prints(docs, key=key, text=text, words=words, lanes=lanes))
    # one row per shingle set, and where to find a text of it
    distinct = staged(marked.groupBy("id", *names).agg(
        F.min("key").alias("least"), F.min(F.struct(
            F.col("key").isNull().alias("none"), "key", "hash")).alias("at")))
    roots = cut_lineage(connected(thinned(links(
        distinct.select("id", *names), bands(lanes), radius, lanes, False, hot))))
    members = roots.select(F.col("node").alias("id"), F.col("root").alias("key")).unionByName(
        roots.select(F.col("root").alias("id"), F.col("root").alias("key")).distinct())
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    wanted = members.join(sizes, "key").withColumn(
        "n", F.when(F.col("n") > group, F.col("n")).otherwise(1)).join(
        distinct.select("id", *names, F.col("at.key").alias("_at"),
                        F.col("at.hash").alias("_hash")), "id")
    t = text_of(text)
    texts = docs.select(F.col(key).alias("_key"), t.alias("text"), F.xxhash64(t).alias("_own"))
    rows = wanted.join(texts, (F.col("_own") == F.col("_hash"))
                       & F.col("_key").eqNullSafe(F.col("_at")))
    edges = exact_links(split_in_pairs(rows, group), words=words, lanes=lanes, radius=radius,
                        similar=similar)
    found = cut_lineage(connected(edges))
    named = distinct.join(found, F.col("id") == F.col("node"), "left").select(
        "id", "least", F.coalesce("root", "id").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = named.join(best, "root").select("id", "component_id")
    return marked.join(by_set, "id").select(F.col("key").alias(key), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5,
             lanes: int = 4, radius: int = 60, similar: float = 0.8, hot: int = HOT,
             group: int = GROUP) -> DataFrame:
    """``docs`` without near copies: of each class the row with the smallest key stays.

    Texts are near copies whose sets of five-word shingles are 0.8 similar, tested exactly.
    Fingerprints only propose: as sets of similarity s have vectors at an angle of
    ``acos(2s / (1 + s))``, 256 bits differ in 39 at 0.8, give or take 6, and the radius
    leaves 3.6 times that spread.  Rows with equal keys and shingle sets are all kept or
    all dropped; rows without a key stay; texts without words are copies of each other.
    Cases otherwise as in :func:`classes`.
    """
    found = similar_classes(docs, key=key, text=text, words=words, lanes=lanes, radius=radius,
                            similar=similar, hot=hot, group=group)
    gone = unused(docs.columns, "_gone")
    dropped = found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(gone))
    return docs.join(dropped.distinct(), docs[key] == F.col(gone), "left_anti")
