"""Token counts of a whole-word BPE tokenizer, without shuffling pre-tokens.

The count of a text is the sum over its pre-tokens, so only the length of each distinct
pre-token matters.  Lengths are looked up in two tiers, both on the map side: a table of
the corpus' frequent pre-tokens, sent to each executor once, and each worker's own cache
of what it has met beyond that.  What neither knows is encoded by the tokenizers library.

The table holds at most ``FREQUENT`` entries whatever the size of the corpus.  It decides
the speed only, never a count.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from ..session import ship_by_value
from .base import text_of, worker_cache
from .byte_bpe import byte_table

ship_by_value(__name__)

FREQUENT = 1 << 16          # entries of the table that is sent
FROM_EACH_TASK = 1 << 12    # candidates a task offers, and the least it counts at a time
CACHED = 1 << 19            # entries of a worker's cache; beyond that it starts anew


@functools.cache
def class_ranges(name: str, top: int = 0x10FFFF) -> str:
    """The members of a class up to ``top``, as the library's regular expressions see it."""
    every = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)
    cut = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True)
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" if len(run) > 1 else
                   f"\\U{ord(run):08x}" for part, _ in cut.pre_tokenize_str(every)
                   for run in _runs(part))


def _runs(part: str) -> Iterator[str]:
    start = 0
    for k in range(1, len(part) + 1):
        if k == len(part) or ord(part[k]) != ord(part[k - 1]) + 1:
            yield part[start:k]
            start = k


class Counting:
    """Pre-token lengths of one tokenizer file.

    The file's own normalizer and pattern are used.  Texts of plain Latin characters are
    normalized here, where composing does nothing; all others go through the library.
    """

    # composed already, and lower-cased alike here and by the library
    PLAIN = re.compile("[^\x00-įı-˿‐-‧€]")

    def __init__(self, file: str, frequent: dict[str, int], classes: list[dict[str, str]]):
        self.whole = Tokenizer.from_str(file)
        parts = json.loads(file)
        self.special = [t["content"] for t in parts["added_tokens"]]
        steps = [n["type"] for n in parts["normalizer"]["normalizers"]]
        cutter, to_bytes = parts["pre_tokenizer"]["pretokenizers"]
        if (steps != ["NFC", "Replace", "Lowercase"] or cutter["behavior"] != "Removed"
                or not cutter["invert"] or to_bytes["type"] != "ByteLevel"):
            raise ValueError("not a lower-casing word tokenizer of the known form")
        pattern = cutter["pattern"]["Regex"]
        # smaller classes match faster, where no other character can occur
        self.ascii, self.plain, self.any = [re.compile(self._explicit(pattern, c))
                                            for c in classes]
        # single pre-tokens need neither normalizer nor cutting
        self.model = self.whole.model
        self.shown = dict(enumerate(byte_table()))
        self.frequent = frequent
        self.known: dict[str, int] = {}

    @staticmethod
    def _explicit(pattern: str, classes: dict[str, str]) -> str:
        for name, ranges in classes.items():
            pattern = pattern.replace(name, ranges)
        return pattern

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if self.PLAIN.search(text) is None:
            return self.plain.findall(text.lower())
        return self.any.findall(self.whole.normalizer.normalize_str(text))

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(self.model.tokenize(p.encode().decode("latin-1").translate(self.shown)))
                for p in pieces]

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.whole.encode(text, add_special_tokens=False))
        pieces = self.pre_tokens(text)
        found = list(map(self.frequent.get, pieces))
        if None not in found:
            return sum(found)
        rest = [p for p, n in zip(pieces, found) if n is None]
        if len(self.known) > CACHED:
            self.known.clear()
        new = [p for p in {*rest} if p not in self.known]
        if new:
            self.known |= zip(new, self.lengths(new))
        return sum([n for n in found if n is not None]) + sum(map(self.known.__getitem__, rest))


def _send(spark, path: str, frequent: dict[str, int]):
    with open(path, encoding="utf-8") as f:
        file = f.read()
    classes = [{name: class_ranges(name, top) for name in (r"\p{L}", r"\p{N}", r"\s")}
               for top in (0x7F, 0x20AC, 0x10FFFF)]
    name = hashlib.sha256(f"{file} {sorted(frequent.items())}".encode()).hexdigest()
    return spark.sparkContext.broadcast((name, file, frequent, classes))


def _counting(sent) -> Counting:
    name, *rest = sent.value
    return worker_cache(f"counting {name}", lambda: Counting(*rest))


def frequent_pre_tokens(docs: DataFrame, path: str, *, text: str = "text",
                        most: int = FREQUENT) -> dict[str, int]:
    """The frequent pre-tokens of the whole corpus, with their lengths in tokens.

    Every text is read.  A task keeps a bounded number of counters: when they are full,
    all but the largest are given up.  It offers its ``FROM_EACH_TASK`` largest, and only
    those are added up, so no table of all pre-tokens is ever moved.
    """
    sent = _send(docs.sparkSession, path, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(sent)
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                seen.update(counting.pre_tokens(t.as_py()))
                if len(seen) > 32 * FROM_EACH_TASK:
                    seen = Counter(dict(seen.most_common(8 * FROM_EACH_TASK)))
        top = seen.most_common(FROM_EACH_TASK)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()),
             pa.array([n for _, n in top], pa.int64())], ["piece", "n"])

    top = (docs.select(text_of(text).alias("text")).mapInArrow(run, "piece string, n bigint")
           .groupBy("piece").agg(F.sum("n").alias("n")).where(F.length("piece") <= 64)
           .orderBy(F.desc("n"), "piece").limit(most))
    pieces = [row.piece for row in top.select("piece").collect()]      # at most ``most``
    return dict(zip(pieces, _counting(sent).lengths(pieces)))


def token_counts(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text",
                 limit: int = 2048, frequent: dict[str, int] | None = None) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row.

    Tokens are those of the library without added ones; special strings inside a text
    count as the library's default has it.  A null text is an empty one: no bytes, no
    tokens.  Null or repeated keys are passed on, other columns are not looked at, texts
    of any length are counted whole, and an empty table gives an empty result.
    """
    if frequent is None:
        frequent = frequent_pre_tokens(docs, path, text=text)
    sent = _send(docs.sparkSession, path, frequent)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(sent)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_bytes"),
                 pa.array([counting.count(t.as_py()) for t in batch.column("text")],
                          pa.int64())], ["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return (rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
            .withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("key", key))
