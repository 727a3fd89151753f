"""Phrase collocations by weighted acyclic automata.

Each task counts the word sequences of its texts and keeps them as an automaton whose paths
are ``language, word, word, ...`` and whose arcs carry the count of the path so far.  It is
built from runs of sorted sequences, level by level from the ends; states with the same
arcs are one state.  Automata are cut by ranges of the path's start, those of one range are
united and their weights summed, and the parts of a phrase are looked up by composing a set
of paths with the automaton of their range.

A path's place is fixed by its first two words: a range of their order, and in large
inputs a hash inside the range, so that a united automaton has a bounded share of the
input however long the table is.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_by_value, staged
from .base import text_of

ship_by_value(__name__)

SHARD = 1 << 18             # words that one automaton of a task is built from, at least
RANGE_BYTES = 4 << 20       # text behind one united automaton
MOST_RANGES = 4096          # ranges; beyond them each is cut by a hash
SAMPLE = 16                 # texts looked at for each range to be balanced
NO_WORD = -1

# Characters that end a piece; the byte that marks them is no UTF-8.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
MARK = b"\xff"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = bytes.maketrans(UPPER + ENDS + b"\t", UPPER.lower() + MARK * len(ENDS) + b" ")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words, with ``MARK`` between pieces."""
    return text.encode().translate(FOLD).replace(MARK, b" \xff ").split()


# ---------------------------------------------------------------- automata


class Paths:
    """Sorted paths with counts: for each level the parent, word and count of its nodes.

    Words are numbers into ``words``, sorted; nodes are sorted by parent and word.
    """

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, ...]]):
        self.words, self.levels = words, levels


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, their summed counts, and the place of each given key."""
    keys, at = np.unique(key, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, count)
    return keys, total, at


def counted(langs: np.ndarray, ids: np.ndarray, starts: int, words: list[bytes],
            depth: int) -> Paths:
    """Paths of all sequences of up to ``depth`` words that begin at the first ``starts``
    places; ``ids`` has ``NO_WORD`` between pieces and ``langs`` a word number throughout."""
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words) + 1, np.int64)
    rank[order] = np.arange(len(words))
    rank[-1] = NO_WORD
    ids, wide = rank[ids], np.int64(len(words))
    at = np.flatnonzero(ids[:starts] != NO_WORD)
    node, levels = np.zeros(len(at), np.int64), []
    for k in range(depth + 1):
        if k > 1:                       # words after the first, while the piece goes on
            inside = at + k - 1 < len(ids)
            at, node = at[inside], node[inside]
            inside = ids[at + k - 1] != NO_WORD
            at, node = at[inside], node[inside]
        symbol = ids[at + k - 1] if k else rank[langs[at]]
        keys, node, count = np.unique(node * wide + symbol, return_inverse=True,
                                      return_counts=True)
        levels.append((keys // wide, keys % wide, count))
    return Paths([words[k] for k in order], levels)


def small_ints(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def to_automaton(paths: Paths) -> bytes:
    """The paths as an acyclic automaton: equal states, from the last level up, are one."""
    used = np.unique(np.concatenate([w for _, w, _ in paths.levels]))
    levels, state = [], np.zeros(len(paths.levels[-1][0]), np.int64)
    for k in range(len(paths.levels) - 1, -1, -1):
        parent, word, count = paths.levels[k]
        arcs = np.stack([np.searchsorted(used, word), count, state])
        n = len(paths.levels[k - 1][0]) if k else 1
        size = np.bincount(parent, minlength=n)
        first = np.cumsum(size) - size
        mark = arcs.astype(np.uint64)
        mixed = mark[0] * np.uint64(0x9E3779B97F4A7C15) + mark[1] * np.uint64(
            0xC2B2AE3D27D4EB4F) + mark[2] * np.uint64(0x165667B19E3779F9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        total = np.r_[np.uint64(0), np.cumsum(mixed ^ (mixed >> np.uint64(32)))]
        sign = total[first + size] - total[first] + size.astype(np.uint64)
        _, rep, kind = np.unique(sign, return_index=True, return_inverse=True)
        like = rep[kind]                # the state that may stand for this one
        # arcs side by side with those of the stand-in; states that differ stay their own
        there = np.minimum(np.arange(len(parent)) - first[parent] + first[like[parent]],
                           max(len(parent) - 1, 0))
        apart = (arcs != arcs[:, there]).any(axis=0) | (size[parent] != size[like[parent]])
        like[np.unique(parent[apart])] = np.unique(parent[apart])
        like = np.where((size == 0) != (size[like] == 0), np.arange(n), like)
        kept, state = np.unique(like, return_inverse=True)
        sizes = size[kept]
        pick = np.repeat(first[kept] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        levels.append((small_ints(sizes), *map(small_ints, arcs[:, pick])))
    return pickle.dumps(([paths.words[k] for k in used.tolist()], levels[::-1]), protocol=5)


def from_automaton(data: bytes) -> Paths:
    """All paths of an automaton, in order."""
    words, packed = pickle.loads(data)
    levels, state = [], np.zeros(1, np.int64)
    for sizes, word, count, target in packed:
        sizes = sizes.astype(np.int64)
        first = np.cumsum(sizes) - sizes
        many = sizes[state]
        parent = np.repeat(np.arange(len(state)), many)
        arc = np.arange(many.sum()) + np.repeat(first[state] - np.cumsum(many) + many, many)
        levels.append((parent, word[arc].astype(np.int64), count[arc].astype(np.int64)))
        state = target[arc].astype(np.int64)
    return Paths(words, levels)


def united(parts: Sequence[Paths]) -> Paths:
    """One set of paths; weights of equal paths are summed."""
    words = sorted(set().union(*[p.words for p in parts]))
    number = {w: k for k, w in enumerate(words)}
    rank = [np.array([number[w] for w in p.words], np.int64) for p in parts]
    node = [np.zeros(1, np.int64)] * len(parts)
    wide, levels = np.int64(max(1, len(words))), []
    for k in range(len(parts[0].levels)):
        key = [node[i][p.levels[k][0]] * wide + rank[i][p.levels[k][1]]
               for i, p in enumerate(parts)]
        keys, total, at = summed(np.concatenate(key),
                                 np.concatenate([p.levels[k][2] for p in parts]))
        node = np.split(at, np.cumsum([len(x) for x in key])[:-1])
        levels.append((keys // wide, keys % wide, total))
    return Paths(words, levels)


def at_least(paths: Paths, least: int) -> Paths:
    """Without counts below ``least``, and without nodes that lead to no other count."""
    levels, wanted = [], np.zeros(0, np.int64)
    for k in range(len(paths.levels) - 1, -1, -1):
        parent, word, count = paths.levels[k]
        count = np.where(count >= least, count, 0) if k else count
        keep = count > 0
        keep[wanted] = True
        place = np.cumsum(keep) - 1
        if levels:
            levels[-1] = (place[levels[-1][0]], *levels[-1][1:])
        levels.append((parent[keep], word[keep], count[keep]))
        wanted = parent[keep]
    return Paths(paths.words, levels[::-1])


def composed(paths: Paths, asked: Sequence[Sequence[bytes]]) -> np.ndarray:
    """Counts of the asked paths: they are followed level by level, all at once."""
    number = {w: k for k, w in enumerate(paths.words)}
    wide = np.int64(max(1, len(paths.words)))
    found, node = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    open_ = np.arange(len(asked))
    for k, (parent, word, count) in enumerate(paths.levels):
        open_ = open_[[len(asked[i]) > k for i in open_.tolist()]]
        if not len(open_):
            break
        symbol = np.array([number.get(asked[i][k], -1) for i in open_.tolist()], np.int64)
        own = parent * wide + word
        key = node[open_] * wide + symbol
        at = np.minimum(np.searchsorted(own, key), max(len(own) - 1, 0))
        hit = (symbol >= 0) & (own[at] == key) if len(own) else np.zeros(len(open_), bool)
        open_, at = open_[hit], at[hit]
        node[open_] = at
        last = np.array([len(asked[i]) == k + 1 for i in open_.tolist()], bool)
        found[open_[last]] = count[at[last]]
    return found


# ---------------------------------------------------------------- ranges


def place_key(path: Sequence[bytes]) -> bytes:
    """Language and first two words."""
    return path[0] + b"\x00" + b" ".join(path[1:3])


class Places:
    """Which united automaton a path belongs to, by language and first two words."""

    def __init__(self, bounds: list[bytes], parts: int):
        self.bounds, self.parts = bounds, parts

    def __len__(self) -> int:
        return (len(self.bounds) + 1) * self.parts

    def of(self, path: Sequence[bytes]) -> int:
        key = place_key(path)
        return bisect_right(self.bounds, key) * self.parts + crc32(key) % self.parts

    def of_nodes(self, paths: Paths) -> list[np.ndarray]:
        """The place of every node; below the second word that of the parent."""
        words, out, names = paths.words, [], [b""]
        for k, (parent, word, _) in enumerate(paths.levels):
            if k > 2:
                out.append(out[-1][parent])
            elif k == 2 and self.parts == 1:
                # most first words lie in one range with all that follows them
                ends = np.array([bisect_right(self.bounds, n + b" \xff") for n in names])
                place = out[-1][parent]
                for i in np.flatnonzero(ends[parent] != place).tolist():
                    place[i] = bisect_right(self.bounds, names[parent[i]] + b" " + words[word[i]])
                out.append(place)
            else:
                before, after = ((b"", b"\x00"), (b"", b""), (b" ", b""))[k]
                names = [names[p] + before + words[w] + after
                         for p, w in zip(parent.tolist(), word.tolist())]
                out.append(np.array([bisect_right(self.bounds, n) * self.parts
                                     + crc32(n) % self.parts for n in names], np.int64))
        return out

    def cut(self, paths: Paths) -> Iterator[tuple[int, Paths]]:
        """The paths of each place; nodes that only lead there have the count zero."""
        places, wide = self.of_nodes(paths), np.int64(len(self))
        below, levels = np.zeros(0, np.int64), []
        for k in range(len(paths.levels) - 1, -1, -1):
            parent, word, count = paths.levels[k]
            own = np.arange(len(parent)) * wide + places[k]
            keys = np.union1d(own, below)
            node, place = keys // wide, keys % wide
            levels.append((node, place, parent[node], word[node],
                           np.where(places[k][node] == place, count[node], 0)))
            below = np.unique(parent[node] * wide + place)
        levels.reverse()
        sorted_ = []
        for node, place, parent, word, count in levels:
            order = np.lexsort((node, place))
            sorted_.append([x[order] for x in (node, place, parent, word, count)])
        for g in np.unique(np.concatenate([s[1] for s in sorted_])).tolist():
            part, above = [], np.zeros(1, np.int64)
            for node, place, parent, word, count in sorted_:
                a, b = np.searchsorted(place, [g, g + 1])
                part.append((np.searchsorted(above, parent[a:b]), word[a:b], count[a:b]))
                above = node[a:b]
            yield g, Paths(paths.words, part)


def places(rows: DataFrame, range_bytes: int) -> Places:
    """Bounds from a few words of some texts; they spread the work and change no result."""
    size, n = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    wanted = max(1, -(-size // range_bytes))
    ranges = min(wanted, MOST_RANGES)
    parts = -(-wanted // ranges)
    if ranges == 1:
        return Places([], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for lang, text in zip(*[batch.column(c).to_pylist() for c in ("lang", "text")]):
                words = words_of(text)
                for at in range(0, len(words), max(1, -(-len(words) // 8))):
                    keys.append(place_key((b"\x00" + lang.encode(), *words[at:at + 2])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], ["key"])

    share = min(1.0, SAMPLE * ranges / n)
    seen = rows.sample(share, 1).mapInArrow(run, "key binary")
    keys = sorted(bytes(r["key"]) for r in seen.collect())
    cuts = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []
    return Places(sorted(set(cuts)), parts)


# ---------------------------------------------------------------- operator


def shards(rows: DataFrame, where: Places, depth: int, shard: int = SHARD) -> DataFrame:
    """``place, automaton``: what each task has counted, cut by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Ids(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = value = len(self)
                return value

        def made(ids: Ids, tokens: np.ndarray, langs: np.ndarray, starts: int):
            mark = ids.get(MARK)
            names = list(ids)
            tokens = np.where(tokens == mark, NO_WORD, tokens) if mark is not None else tokens
            for place, paths in where.cut(counted(langs, tokens, starts, names, depth)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int64()),
                     pa.array([to_automaton(paths)], pa.binary())], ["place", "automaton"])

        ids, tokens, langs, held = Ids(), [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                lang = ids[b"\x00" + batch.column("lang")[k].as_py().encode()]
                here = np.fromiter(map(ids.__getitem__, words_of(
                    batch.column("text")[k].as_py())), np.int64)
                while len(here) > shard:        # a long text, piece by piece
                    chunk, here = here[:shard + depth - 1], here[shard:]
                    yield from made(ids, chunk, np.full(len(chunk), lang), shard)
                tokens += [here, [ids[MARK]]]
                langs.append(np.full(len(here) + 1, lang))
                held += len(here)
                if held >= shard:
                    whole = np.concatenate(tokens).astype(np.int64)
                    yield from made(ids, whole, np.concatenate(langs), len(whole))
                    ids, tokens, langs, held = Ids(), [], [], 0
        if held:
            whole = np.concatenate(tokens).astype(np.int64)
            yield from made(ids, whole, np.concatenate(langs), len(whole))

    return rows.mapInArrow(run, "place bigint, automaton binary")


def union_by_place(parts: DataFrame, least: int) -> DataFrame:
    """The united automaton of each place, without counts below ``least``, in a row of its
    own, and its paths as rows ``place, lang, phrase, size, f``."""
    def run(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        paths = at_least(united([from_automaton(a.as_py()) for a in table.column("automaton")]),
                         least)
        names: list[tuple[str, str]] = [("", "")]
        rows = [(None, None, None, None, to_automaton(paths))]
        text = [w.decode(errors="replace") for w in paths.words]
        for k, (parent, word, count) in enumerate(paths.levels):
            deeper = []
            for p, w, n in zip(parent.tolist(), word.tolist(), count.tolist()):
                lang, phrase = names[p]
                own = (text[w][1:], "") if k == 0 else (
                    lang, f"{phrase} {text[w]}" if k > 1 else text[w])
                deeper.append(own)
                if n:
                    rows.append((*own, k, n, None))
            names = deeper
        lang, phrase, size, f, machine = zip(*rows)
        return pa.table({
            "place": pa.array([place] * len(rows), pa.int64()), "lang": pa.array(lang, pa.string()),
            "phrase": pa.array(phrase, pa.string()), "size": pa.array(size, pa.int32()),
            "f": pa.array(f, pa.int64()), "automaton": pa.array(machine, pa.binary())})

    return parts.groupBy("place").applyInArrow(
        run, "place bigint, lang string, phrase string, size int, f bigint, automaton binary")


def looked_up(asked: DataFrame, machines: DataFrame, where: Places) -> DataFrame:
    """``lang, phrase, f`` for every distinct ``lang, phrase`` asked for."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, phrase = (batch.column(c).to_pylist() for c in ("lang", "phrase"))
            at = [where.of((b"\x00" + a.encode(), *p.encode().split(b" ")))
                  for a, p in zip(lang, phrase)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), batch.column("lang"), batch.column("phrase")],
                ["place", "lang", "phrase"])

    def run(wanted: pa.Table, machine: pa.Table) -> pa.Table:
        lang, phrase = (wanted.column(c).to_pylist() for c in ("lang", "phrase"))
        found = np.zeros(len(lang), np.int64)
        for data in machine.column("automaton"):
            found += composed(from_automaton(data.as_py()),
                              [(b"\x00" + a.encode(), *p.encode().split(b" "))
                               for a, p in zip(lang, phrase)])
        return pa.table({"lang": pa.array(lang, pa.string()),
                         "phrase": pa.array(phrase, pa.string()),
                         "f": pa.array(found, pa.int64())})

    routed = asked.mapInArrow(route, "place bigint, lang string, phrase string")
    return routed.groupBy("place").cogroup(machines.groupBy("place")).applyInArrow(
        run, "lang string, phrase string, f bigint")


def piece(words: Column, start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang",
                 most_words: int = 3, least: int = 10, cover: int = 50, top: int = 2000,
                 range_bytes: int = RANGE_BYTES, shard: int = SHARD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    A phrase has two to ``most_words`` words of one piece of text and occurs ``a >= least``
    times.  A cut into a first part, seen ``l`` times, and a rest, seen ``r`` times, has the
    score ``floor(10**6 * a * a / (l * r))``; its lowest cut counts, the earliest of equal
    ones.  Phrases inside a longer one with at least ``cover`` per cent of their count are
    left out.  ``n`` is the number of words of the language.  Ties in score go to the larger
    count, then to the phrase first in byte order.

    Counts cover all texts and are exact; ``range_bytes`` and ``shard`` change the spread of
    the work only.  A null text is empty, a null language is ``und``; repeated rows count
    repeatedly; other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       text_of(text).alias("text"))
    where = places(rows, range_bytes)
    grams = staged(union_by_place(shards(rows, where, most_words, shard), least))
    found = grams.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    cuts = found.where(F.col("a") >= least).select("*", F.explode(
        F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "*", piece(words, F.lit(1), F.col("k")).alias("first"),
        piece(words, F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    asked = cuts.select("lang", F.col("first").alias("phrase")).unionByName(
        cuts.select("lang", F.col("rest").alias("phrase"))).distinct()
    machines = grams.where("automaton IS NOT NULL").select("place", "automaton")
    counts = staged(looked_up(asked, machines, where))
    exact = "decimal(15,0)"
    scored = (cuts.join(counts.select("lang", F.col("phrase").alias("first"),
                                      F.col("f").alias("l")), ["lang", "first"])
              .join(counts.select("lang", F.col("phrase").alias("rest"),
                                  F.col("f").alias("r")), ["lang", "rest"])
              .withColumn("score", F.expr(
                  f"(1000000BD * cast(a AS {exact}) * cast(a AS {exact}))"
                  f" div (cast(l AS {exact}) * cast(r AS {exact}))")))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"),
        F.max("a").alias("a"))
    inner = found.where("size > 2").select(
        "lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda s: F.transform(F.sequence(F.lit(1), F.col("size") - s + 1),
                                  lambda i: piece(words, i, s))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    total = grams.where("size = 0").select("lang", F.col("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
