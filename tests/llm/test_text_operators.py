"""Tokenizers, personal data, secrets and quality rules against brute force."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import byte_bpe, pii, quality, secrets, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", " ", "a", "Hello world's don't 'S  \n\n x\t1234", "été 中文 🙂 \u0085  é ﬁ İΣς ẞ",
    "<|endoftext|> and <|startoftext|>", "AAAA" * 300, " " * 400, "x " * 3000,
    "mixed 🙂é" * 50, "a" * 5000, "\x1c\x1f   ᠎ ​", "Hello world's don't 'S",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 5 else None, t, "clash", k) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[:4], "doc_id long, text string, key string, ids long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS),
                             special_tokens={})


def test_byte_bpe_matches_the_library(docs, empty):
    own = reference()
    got = byte_bpe.encode(docs, RANKS, PATTERN)
    assert got.columns == ["doc_id", "ids", "starts", "ends"]
    want = sorted(own.encode_ordinary(t or "") for t in TEXTS + TEXTS[:4])
    assert sorted(r["ids"] for r in got.collect()) == want
    assert byte_bpe.encode(empty, RANKS, PATTERN).count() == 0


def test_byte_bpe_round_trip_and_split_characters(docs, spark):
    coded = byte_bpe.encode(docs, RANKS, PATTERN, offsets=False)
    back = byte_bpe.decode(coded, RANKS, PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(
        t or "" for t in TEXTS + TEXTS[:4])
    half = reference().encode_ordinary("🙂")
    assert len(half) > 1
    rows = spark.createDataFrame([(1, half[:1]), (2, None), (3, half)], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r for r in byte_bpe.decode(rows, RANKS, PATTERN).collect()}
    assert "�" in got[1]["text"] and got[2]["text"] is None and got[3]["text"] == "🙂"


def test_byte_bpe_offsets(docs):
    for r in byte_bpe.encode(docs, RANKS, PATTERN).collect():
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), byte_bpe.explicit_patterns(PATTERN))
    text = "Hi 🙂 été"
    ids = codec.encode(text)
    starts, ends = codec.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text)
    whole = text.encode()
    at = 0
    for token, s, e in zip(codec.token_bytes(ids), starts, ends):
        first = len(whole[:at].decode("utf-8", "ignore"))
        assert s == first and token in text[s:e].encode()
        at += len(token)


def test_byte_bpe_fuzz_and_long_texts():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), byte_bpe.explicit_patterns(PATTERN))
    own, rng = reference(), random.Random(1)
    parts = ["a", "aa", " ", "  ", "\n", "'s", "é", "中", "🙂", "1", "==", "\u0085", " "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert memoryview(codec.encode(text)).cast("I").tolist() == own.encode_ordinary(text)
    long = ("some words, and  more\n" * 60_000)
    assert len(long) > byte_bpe.PART_CHARS
    assert memoryview(codec.encode(long)).cast("I").tolist() == own.encode_ordinary(long)


def test_byte_bpe_every_character():
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), byte_bpe.explicit_patterns(PATTERN))
    text = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}b " for c in range(0x110000)
                   if not 0xD800 <= c < 0xE000)
    assert memoryview(codec.encode(text)).cast("I").tolist() == reference().encode_ordinary(text)


def test_token_counts_match_the_library(docs, empty):
    own = Tokenizer.from_file(WORDS)
    got = token_counts.token_counts(docs, WORDS, limit=900)
    want = sorted((len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False)))
                  for t in TEXTS + TEXTS[:4])
    rows = got.collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 900) for r in rows)
    assert token_counts.token_counts(empty, WORDS).count() == 0


def test_frequent_table_changes_no_count(docs):
    table = token_counts.frequent_pre_tokens(docs, WORDS, most=5)
    assert 0 < len(table) <= 5
    one = token_counts.token_counts(docs, WORDS, frequent={}).orderBy("n_bytes", "n_tokens")
    two = token_counts.token_counts(docs, WORDS, frequent=table).orderBy("n_bytes", "n_tokens")
    assert one.drop("doc_id").collect() == two.drop("doc_id").collect()


def test_token_counts_every_character():
    with open(WORDS, encoding="utf-8") as f:
        file = f.read()
    names = (r"\p{L}", r"\p{N}", r"\s")
    classes = [{n: token_counts.class_ranges(n, top) for n in names}
               for top in (0x7F, 0x20AC, 0x10FFFF)]
    counting = token_counts.Counting(file, {}, classes)
    own = Tokenizer.from_file(WORDS)
    for low in range(0, 0x110000, 256):
        text = "".join(f"A{chr(c)}1{chr(c)}! {chr(c)}b e{chr(c)} Σ" for c in range(low, low + 256)
                       if not 0xD800 <= c < 0xE000)
        assert counting.count(text) == len(own.encode(text, add_special_tokens=False)), hex(low)


# ---------------------------------------------------------------- personal data


def base_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


PIECES = ["a", "b.c", "@", "@x.y", "1", "12", "255", ".", "300.", "+", " ", "-", "(", "_", "é",
          "4111 1111 1111 1111", "DE89370400440532013000", " tel ", "\n", "030 1234567"]


def test_pii_base_kinds(spark, empty):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", "1" * 3000, "x@" * 500 + "a.b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digests(pii.find_pii(docs)).collect():
        want = base_pii(texts[r["doc_id"]] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(w[0] == k for w in want)
                                                   for k in pii.BASE]
        assert r["spans"].startswith(text)
    assert pii.find_pii(empty).count() == 0


def test_pii_checksums_and_context():
    def kinds(text):
        return [(s.kind, text[s.start:s.end]) for s in pii.spans_of(text)]

    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == [
        ("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("DE88 3704 0044 0532 0130 00") == []          # checksum fails
    assert kinds("amex card 378282246310005") == [("short_card", "378282246310005")]
    assert kinds("number 378282246310005") == []               # no context
    assert kinds("call 030 1234567 now") == [("local_phone", "030 1234567")]
    assert kinds("part 030 1234567 now") == []


def test_accounts_in_a_row_and_of_all_countries():
    def accounts(text):
        return [text[s.start:s.end] for s in pii.spans_of(text) if s.kind == "iban"]

    one, two = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    assert accounts(f"{one} {two}") == [one, two]
    assert accounts(f"AB12 CODE 9999 1111 2222 {two}") == [two]        # no account before it
    assert accounts(f"DE88 3704 0044 0532 0130 00 {two}") == [two]     # checksum fails
    assert accounts("DE89  3704 0044 0532 0130 00") == []
    for a in ("BR1800360305000010009795493C1", "UA213223130000026007233566001",
              "RS35260005601001611379", "TN5910006035183598478831",
              "KW81CBKU0000000000001234560101", "QA58DOHB00001234567890ABCDEFG",
              "PK36SCBL0000001123456702", "KZ86125KZT5004100100", "GE29NB0000000101904917"):
        assert accounts(f"pay to {a}.") == [a], a


# ---------------------------------------------------------------- secrets


def base_secrets(text):
    out = []
    assign = (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
              r"([A-Za-z0-9+/_.=-]+)")
    for m in re.finditer(assign, text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, m.end(), "hex"))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_secret_base_kinds(spark, empty):
    rng = random.Random(4)
    parts = ["token", "PASSWORD", "api_key", "=", ": ", '"', "abc", "abcdefgh", "AKIA", "ABCDEFGH1234",
             "0123456789abcdef", "é", "\n", " ", "🙂", ".", "secret"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    texts += [None, "", "token=api_key: abcdefgh", "x" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in secrets.digests(secrets.find_secrets(docs)).collect():
        want = base_secrets(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
    assert secrets.find_secrets(empty).count() == 0


SYLLABLES = ["con", "fig", "ura", "tion", "net", "work", "in", "ter", "nal", "path", "doc",
             "ment", "fold", "er", "file", "get", "the", "cur", "rent", "user", "ac", "count"]
PLAIN = ["configuration_of_the_internal-network-2024", "abcdefghijklmnopqrstuvwxyz",
         "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "path/to/some/document/folder/file",
         "GetTheCurrentUserAccountName", "2024-01-01-2024-12-31-2025", "1234567890" * 3]
RANDOM = {"base32": (string.ascii_uppercase + "234567", 32), "lower": (string.ascii_lowercase, 32),
          "base36": (string.ascii_lowercase + string.digits, 32),
          "base62": (string.ascii_letters + string.digits, 40),
          "base64": (string.ascii_letters + string.digits + "+/", 40)}


def made_of_words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(5)
    rows = [(name, f"here it is {''.join(rng.choice(letters) for _ in range(n))} and more")
            for name, (letters, n) in RANDOM.items() for _ in range(60)]
    rows += [(s, f"here it is {s} and more") for s in PLAIN]
    rows += [(None, made_of_words(rng, 100)) for _ in range(300)]
    docs = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)],
                                 "doc_id long, kind string, text string, tried string, hex int")
    found = {r["doc_id"]: r["random"] for r in secrets.find_secrets(docs.repartition(4)).collect()}
    for name, (_, n) in RANDOM.items():
        own = [k for k, r in enumerate(rows) if r[0] == name]
        hits = [k for k in own if found[k]]
        assert len(hits) >= 0.9 * len(own), name
        assert all(tuple(found[k][0]) == (11, 11 + n) for k in hits)
    assert not any(found[k] for k, r in enumerate(rows) if r[0] is None or r[0] in PLAIN)


def battery_by_hand(s, model):
    """Mean deviate of the three tests of one string from structure, and its encoding."""
    body = s.rstrip("=")
    k = next(i for i, (p, _) in enumerate(secrets.ENCODINGS.values()) if re.fullmatch(p, body))
    letters = list(secrets.ENCODINGS.values())[k][1]
    n, s2, s3, t = len(body), model.squares[k], model.cubes[k], model.turns[k]
    equal = sum(body[i] == body[j] for i in range(n) for j in range(i))
    every = n * (n - 1) / 2
    chi = (every * s2 - equal) / (every * (s2 - s2**2)
                                  + 2 * every * (n - 2) * max(0, s3 - s2**2)) ** 0.5
    high = [letters.index(c) > (len(letters) - 1) / 2 for c in body]
    turned = sum(a != b for a, b in zip(high, high[1:]))
    more = (turned - (n - 1) * t) / ((n - 1) * t * (1 - t)) ** 0.5
    at = [secrets.ALL.index(c) for c in body]
    score = sum(model.score[a, b] for a, b in zip(at, at[1:])) / (n - 1)
    serial = (model.mean - score) / (model.spread / (n - 1) + model.between) ** 0.5
    return (chi + (more if t < 0.5 else -more) + serial) / 3


def test_battery_and_control_by_hand(spark):
    rng = random.Random(7)
    words = [made_of_words(rng, 60) for _ in range(80)]
    strings = ["".join(rng.choice(a) for _ in range(rng.randint(20, 90)))
               for a, _ in RANDOM.values() for _ in range(25)]
    strings += ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(8, 20)))
                for _ in range(100)] + PLAIN + ["x" * 6000, "Ab3" * 4000 + "=="]
    texts = words + [f"<{s}>" for s in strings]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secrets.structure(docs)

    # the model: pairs of characters inside short strings
    tokens = [t for x in texts for t in re.findall(secrets.TOKEN, x)]
    pairs = [secrets.ALL.index(a) * 66 + secrets.ALL.index(b) for t in tokens
             for a, b in zip(t, t[1:])]
    flat = model.score.ravel()
    assert model.mean == pytest.approx(sum(flat[p] for p in pairs) / len(pairs))

    scanned = secrets.scan(docs, model=model)
    tried = {r["doc_id"] - len(words): r["tried"][0] for r in scanned.collect() if r["tried"]}
    assert set(tried) >= {k for k, s in enumerate(strings) if not re.search("[0-9a-f]{32}", s)}
    for k, c in tried.items():
        z = battery_by_hand(strings[k], model)
        assert math.log(c["test"]["p"]) == pytest.approx(
            math.log(max(1e-300, 0.5 * math.erfc(z / 2**0.5) or 1e-300)), rel=0.02, abs=0.01)

    # the control: per class of length, the lowest bin whose expected share of false ones is small
    cells = Counter((c["class"], min(150, math.floor(-10 * math.log10(c["test"]["p"]))))
                    for c in tried.values() if c["test"]["chi"] < 3.3
                    and abs(c["test"]["runs"]) < 3.3 and abs(c["test"]["serial"]) < 3.3)
    want = {}
    for kind, low in sorted(cells, reverse=True):
        whole = sum(n for (c, _), n in cells.items() if c == kind)
        above = sum(n for (c, b), n in cells.items() if c == kind and b >= low)
        if whole * 10 ** (-low / 10) / above <= secrets.RATE:
            want[kind] = low
    got = {r["class"]: r["least"] for r in secrets.thresholds(scanned).collect()}
    assert got == want and got


def test_secret_edges(spark):
    """Null and repeated keys, null texts, clashing columns; few texts show no structure."""
    key = "Zk3xQ9vLw2RtYb7NcPf5Hd8MsJg4TuVe6A1B"
    rows = [(None, f"a {key} b"), (1, f"a {key} b"), (1, f"a {key} b"), (2, None), (None, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "doc_id long, text string, assign string, random int")
    got = secrets.digests(secrets.find_secrets(docs)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 1, 2]
    assert all(r["spans"] == "" for r in got)
    rng = random.Random(8)
    model = secrets.structure(spark.createDataFrame(
        [(made_of_words(rng, 300),) for _ in range(50)], "text string"))
    got = secrets.digests(secrets.find_secrets(docs, model=model)).collect()
    assert sorted(r["spans"] for r in got) == ["", ""] + [f"random:2:{2 + len(key)}"] * 3


# ---------------------------------------------------------------- quality


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {k + o for k, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, empty):
    rng = random.Random(6)
    parts = ["a", "b", "c d", "\n", "\n\n", "#", "é🙂", " ", "\x0b", "a b c\n", " "]
    texts = [None, "", "a b c a b c", "a a a a"] + [
        " ".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame(
        [(k, t, rng.choice(["x", "y", None])) for k, t in enumerate(texts)],
        "doc_id long, text string, source string")
    for r in quality.report(docs).collect():
        want = brute_measures(texts[r["doc_id"]] or "")
        assert tuple(r[c] for c in quality.MEASURES[:5]) == want
        n, repeat = want[0], want[4]
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.report(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_host_verdicts(spark):
    clean = " ".join(f"word{k}" for k in range(80))
    noisy = clean + " ### " * 20
    rows = ([(k, noisy, "bad", 1) for k in range(60)] + [(60, clean, "bad", 1)]
            + [(100 + k, clean, "good", 1) for k in range(60)] + [(200, noisy, "good", 1),
                                                                   (201, noisy, None, 1)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _host long")
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    # clean documents of a rejected host stay; noisy ones go there and stay elsewhere
    assert kept == {60, 200, *range(100, 160)} | ({201} & kept)
    rates = {r["host"]: r for r in quality.host_rates(quality.measured(docs, out="m"), out="m").collect()}
    assert rates["bad"]["rate"] > 0.5 > rates["good"]["rate"]
    assert rates["good"]["rate"] > 1 / 61          # drawn towards the corpus


def test_normal_tail(spark):
    """Within 0.3 per cent of the true tail, far out as well."""
    at = [-5.0, -1.0, 0.0, 0.5, 1.0, 3.0, 8.0, 20.0, 37.0]
    df = spark.createDataFrame([(z,) for z in at], "z double")
    for r in df.select("z", secrets.normal_tail(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / 2**0.5), rel=4e-3)
    assert df.select(secrets.normal_tail(F.lit(1e6)).alias("p")).first()["p"] > 0


def test_long_random_strings_are_found(spark):
    rng = random.Random(8)
    letters = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(letters) for _ in range(10_000)) for _ in range(6)]
    texts = [f"it is {s} ." for s in keys] + [made_of_words(rng, 100) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["random"] for r in secrets.find_secrets(docs).collect()}
    assert sum(bool(f) for f in found.values()) >= 5 and not any(found[k] for k in range(6, 106))
    assert all(tuple(f[0]) == (6, 10_006) for f in found.values() if f)
