"""Byte-level BPE encoding and decoding.

A rank file gives byte strings and their merge order.  The tokenizers library wants
characters, so each byte stands for one printable character (``byte_table``); a text is
cut by the splitting pattern, and each distinct piece is encoded once per worker by the
library and then kept.  Decoding puts ids back into byte strings through the reversed
table; bytes are joined before they are read as UTF-8, because a token may end inside a
character.

The pattern's classes (letters, numbers, white space) differ between regular-expression
engines by their Unicode versions.  They are taken once, on the driver, from the library
whose ids are to be matched, and written out as ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import models

from ..session import ship_by_value
from .base import text_of, worker_cache

ship_by_value(__name__)

CACHED_PIECES = 1 << 18     # pieces a worker keeps; beyond that it starts anew
PART_CHARS = 1 << 20        # longer texts are cut into pieces part by part


def byte_table() -> list[str]:
    """The character that stands for each byte.

    Visible characters of Latin-1 stand for themselves, the other bytes for the
    characters from U+0100 on, in order.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, extra = [], 0x100
    for b in range(256):
        if b in visible:
            table.append(chr(b))
        else:
            table.append(chr(extra))
            extra += 1
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


TOPS = (0x7F, 0xFF, 0xFFFF, 0x10FFFF)      # small classes match faster


def class_ranges(name: str, top: int = TOPS[-1]) -> str:
    """The members of a regular-expression class such as ``\\p{L}`` up to ``top``."""
    single = {bytes([b]): b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=f"{name}+", mergeable_ranks=single,
                              special_tokens={})
    every = "".join(chr(c) for c in range(top + 1) if not 0xD800 <= c < 0xE000)
    spans: list[list[int]] = []
    for c in map(ord, bytes(probe.encode_ordinary(every)).decode()):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def explicit_patterns(pattern: str) -> list[str]:
    """The pattern for Python's ``re``, with its Unicode classes written out: one form for
    texts whose characters reach up to each of ``TOPS``."""
    def written(top: int) -> str:
        inside = {name: class_ranges(name, top) for name in (r"\p{L}", r"\p{N}", r"\s")}

        def classes(m: re.Match) -> str:
            found = m[0]
            if found.startswith("["):
                for name, ranges in inside.items():
                    found = found.replace(name, ranges)
                return found
            return f"[^{inside[r'\s']}]" if found == r"\S" else f"[{inside[found]}]"

        return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", classes, pattern)

    return [written(top) for top in TOPS]


def tier(text: str) -> int:
    """The first of ``TOPS`` that no character of the text exceeds."""
    if text.isascii():
        return 0
    try:
        text.encode("latin-1")
        return 1
    except UnicodeEncodeError:
        return 3 if re.search("[\U00010000-\U0010ffff]", text) else 2


class Codec:
    """Encoder and decoder of one rank file, with patterns for Python's ``re``."""

    def __init__(self, ranks: dict[bytes, int], patterns: list[str]):
        table = byte_table()
        self.table = dict(enumerate(table))
        self.splits = [re.compile(p) for p in patterns]

        def shown(token: bytes) -> str:
            return "".join([table[b] for b in token])

        merges = [(shown(token[:cut]), shown(token[cut:]))
                  for token in sorted(ranks, key=ranks.get) for cut in range(1, len(token))
                  if token[:cut] in ranks and token[cut:] in ranks]
        vocab = {shown(token): rank for token, rank in ranks.items()}
        # a piece that is a token by itself is never merged
        self.model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        back = {c: b for b, c in enumerate(table)}
        self.tokens = {i: bytes([back[c] for c in token]) for token, i in vocab.items()}
        self.known: dict[str, bytes] = {}       # piece -> its ids, 4 bytes each

    def pieces(self, text: str) -> Iterator[list[str]]:
        """All matches of the pattern, in parts that begin where no match can span: at a
        white space after something else."""
        start, split = 0, self.splits[tier(text)]
        edge = re.compile(r"(?<=[A-Za-z0-9.,;:!?])[ \n]")
        while len(text) - start > PART_CHARS:
            cut = edge.search(text, start + PART_CHARS)
            if cut is None:
                break
            yield split.findall(text[start:cut.start()])
            start = cut.start()
        yield split.findall(text[start:] if start else text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for pieces in self.pieces(text):
            ids = list(map(self.known.get, pieces))
            if None in ids:
                if len(self.known) > CACHED_PIECES:
                    self.known.clear()
                for piece in pieces:
                    if piece not in self.known:
                        shown = piece.encode().decode("latin-1").translate(self.table)
                        self.known[piece] = np.array(
                            [t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
                ids = map(self.known.__getitem__, pieces)
            out.append(b"".join(ids))
        return b"".join(out)

    def token_bytes(self, ids: bytes) -> list[bytes]:
        return list(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.token_bytes(ids))

    def offsets(self, text: str, ids: bytes) -> tuple[list[int], list[int]]:
        """First character of each token and the one after its last.

        A token that holds only part of a character covers that character.
        """
        first_byte = []                   # of each character
        at = 0
        for c in text:
            first_byte.append(at)
            at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        starts, ends, char, at = [], [], 0, 0
        for token in self.token_bytes(ids):
            while char + 1 < len(first_byte) and first_byte[char + 1] <= at:
                char += 1
            starts.append(char)
            at += len(token)
            last = char
            while last + 1 < len(first_byte) and first_byte[last + 1] < at:
                last += 1
            ends.append(last + 1)
        return starts, ends


def ship(spark, ranks_path: str, pattern: str):
    """The rank file and the written-out pattern, sent to each executor once.

    The size is that of the vocabulary, whatever the size of the corpus.
    """
    ranks, patterns = read_ranks(ranks_path), explicit_patterns(pattern)
    name = hashlib.sha256(patterns[-1].encode() + b"\0".join(sorted(ranks, key=ranks.get)))
    return spark.sparkContext.broadcast((name.hexdigest(), ranks, patterns))


def _codec(shipped) -> Codec:
    name, ranks, patterns = shipped.value
    return worker_cache(f"codec {name}", lambda: Codec(ranks, patterns))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id",
           text: str = "text", offsets: bool = True) -> DataFrame:
    """``key, ids`` and, if wanted, ``starts, ends`` (character offsets) for every row.

    Map-only: one output row per input row, in no particular order.  A null text is an
    empty one and gives no ids; null or repeated keys are passed on; no other column is
    looked at.  Texts of any length are encoded whole.
    """
    shipped = ship(docs.sparkSession, ranks_path, pattern)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            coded = [codec.encode(t.as_py()) for t in batch.column("text")]
            # ids stay packed: as Python numbers a batch would take nine times the memory
            ends = np.cumsum([0, *[len(c) // 4 for c in coded]], dtype=np.int32)
            ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(coded), "<i4"))
            columns, names = [batch.column("key"), ids], ["key", "ids"]
            if offsets:
                both = [codec.offsets(t.as_py(), c) for t, c in zip(batch.column("text"), coded)]
                columns += [pa.array([b[k] for b in both], pa.list_(pa.int32()))
                            for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = ", starts array<int>, ends array<int>" if offsets else ""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    coded = rows.mapInArrow(run, f"key {kind}, ids array<int>{more}")
    return coded.withColumnRenamed("key", key)


def decode(coded: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id",
           ids: str = "ids") -> DataFrame:
    """``key, bytes, text`` for every row of ids.

    ``bytes`` are exact; ``text`` replaces what is not UTF-8 (ids that begin or end
    inside a character).  Null ids give null; an unknown id is an error.
    """
    shipped = ship(coded.sparkSession, ranks_path, pattern)
    kind = dict(coded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            joined = [None if row is None else b"".join([codec.tokens[i] for i in row])
                      for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(joined, pa.binary()), pa.array(
                    [None if b is None else b.decode("utf-8", "replace") for b in joined],
                    pa.string())], ["key", "bytes", "text"])

    rows = coded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {kind}, bytes binary, text string").withColumnRenamed(
        "key", key)


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: each text encoded, and its ids
    decoded again, in the same task.  Nulls and repeats as in :func:`encode`."""
    shipped = ship(docs.sparkSession, ranks_path, pattern)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shipped)
        for batch in batches:
            n, ids, back = [], [], []
            for t in batch.column("text"):
                coded = codec.encode(t.as_py())
                n.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                back.append(hashlib.sha256(codec.decode(coded)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(back, pa.string())],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(
        run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("key", key)
