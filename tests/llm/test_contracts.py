"""Columns of the registered queries against plain Python, over the smallest tables."""

import hashlib
import os
import re
import struct

import pandas as pd
import pytest
import tiktoken
import xxhash
from public_tokenizers import PATTERN, path
from test_text_operators import base_secrets
from tokenizers import Tokenizer

from tallyloom.llm import byte_bpe, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    frame = pd.read_parquet(f"{FOLDER}/documents.parquet")
    return {int(r.doc_id): ("" if pd.isna(r.text) else r.text,
                            None if pd.isna(r.source) else r.source)
            for r in frame.itertuples()}


def rows(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, FOLDER).collect()}


def test_mixing(spark, docs):
    size = {k: len(WORD.findall(t)) for k, (t, _) in docs.items()}
    sources = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, s or ""))
    own = {s: sum(size[k] for k, d in docs.items() if d[1] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    full, open_ = {}, set(sources)
    while True:
        left = 1.5 * sum(own.values()) - sum(full.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > 2 * own[s]}
        if not above:
            break
        full |= {s: 2.0 * own[s] for s in above}
        open_ -= above
    want = full | {s: level * weight[s] for s in open_}
    got, taken = rows(spark, "op1_mixing"), dict.fromkeys(sources, 0)
    for k, (_, s) in docs.items():
        r = got[k]
        assert (r["size"], r["source_size"]) == (size[k], own[s])
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * size[k] and (not size[k] or r["taken"] % size[k] == 0)
        taken[s] += r["taken"]
    for s in sources:
        longest = max(size[k] for k, d in docs.items() if d[1] == s)
        assert abs(taken[s] - want[s]) <= longest
    again = rows(spark, "op1_mixing")
    assert {k: r["taken"] for k, r in got.items()} == {k: r["taken"] for k, r in again.items()}


def test_byte_bpe(spark, docs):
    own = tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(path("byte_bpe_50k.tiktoken")))
    for k, r in rows(spark, "op2_byte_bpe").items():
        ids = own.encode_ordinary(docs[k][0])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[k][0].encode()).hexdigest()


def test_simhash(spark, docs):
    fingerprint = {}
    for k, (text, _) in docs.items():
        words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fingerprint[k] = sum(1 << b for b in range(64)
                             if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in docs}
    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[:i]:
            if root[a] != root[b] and (fingerprint[a] ^ fingerprint[b]).bit_count() <= 3:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    got = rows(spark, "op5_simhash")
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {
        k: (f"{fingerprint[k]:016x}", root[k]) for k in docs}


def test_token_counts(spark, docs):
    own = Tokenizer.from_file(path("word_bpe_49k.json"))
    own.no_padding()
    own.no_truncation()
    for k, r in rows(spark, "op6_token_counts").items():
        n = len(own.encode(docs[k][0], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (
            len(docs[k][0].encode()), n, n > 2048)


def luhn(digits):
    twice = [2 * int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def base_pii(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+",
         lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15))
    return {name: [(m.start(), m.end()) for m in re.finditer(p, text) if good(m[0])]
            for name, p, good in kinds}


def test_personal_data(spark, docs):
    for k, r in rows(spark, "op9_pii").items():
        found = base_pii(docs[k][0])
        spans = [f"{kind}:{a}:{b}" for kind, at in found.items() for a, b in at]
        assert [r[f"n_{kind}"] for kind in found] == [len(at) for at in found.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(","))


def test_secrets(spark, docs):
    for k, r in rows(spark, "op10_secrets").items():
        spans = base_secrets(docs[k][0])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        counts = [sum(s.startswith(kind) for s in spans.split(",")) for kind in
                  ("assign", "access", "hex")]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_sharding(spark, docs):
    """Counts at most one apart, slots without gaps, sizes and checksums of the texts."""
    import zlib
    got = rows(spark, "op7_sharding")
    slots = {}
    for k, r in got.items():
        data = docs[k][0].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "rows")
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
