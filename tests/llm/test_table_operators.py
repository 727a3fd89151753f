"""Near and exact duplicates, mixing, sharding, URL filters and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import (components, exact_dedup, mixing, quality, sharding, simhash,
                           url_filter)

SCHEMA = "doc_id long, text string, source string, _part double, _gone long, copies int"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 0.5, 7, 3) for r in rows], SCHEMA)


# ---------------------------------------------------------------- components, simhash


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(900, 999)]
    edges += [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components.connected(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for v in root if find(v) != v}


def plain_fingerprint(text, words=3):
    w = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                     "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not w:
        return 0
    words = min(words, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + words]), 42)
         for k in range(len(w) - words + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts_with_copies(rng, n=150):
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 60))]
        rows.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(vocab)
            rows.append(" ".join(v) if rng.random() < 0.7 else " ".join(w).upper())
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash_against_all_pairs(spark, hot):
    rng = random.Random(2)
    texts = [None, "", " \t ", "A b", "a B", *texts_with_copies(rng)]
    prints = [plain_fingerprint(t or "") for t in texts]
    near = [[(a ^ b).bit_count() <= 3 for b in prints] for a in prints]
    best = list(range(len(texts)))
    while True:
        new = [min(best[j] for j in range(len(texts)) if near[i][j]) for i in range(len(texts))]
        if new == best:
            break
        best = new
    docs = table(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in simhash.classes(docs, hot=hot).collect()}
    assert len(got) == len(texts)
    for k, p in enumerate(prints):
        assert got[k]["f0"] % (1 << 64) == p and got[k]["component_id"] == best[k]


def test_bit_sliced_comparison():
    rng = np.random.default_rng(3)
    for lanes, radius in ((1, 3), (2, 20), (1, 0), (1, 7)):
        f = [rng.integers(0, 1 << 63, 200).astype(np.int64) for _ in range(lanes)]
        for k in range(0, 190, 3):                     # near neighbours
            for x in f:
                x[k + 1] = x[k] ^ (1 << int(rng.integers(0, 63)))
        bits = simhash.planes(f)
        for d in (1, 2, 64, 65):
            n = 200 - d
            open_ = simhash.words_of(np.ones(n, bool))
            got = simhash.within(simhash.words_of(bits[:, :n]), simhash.words_of(bits[:, d:]),
                                 open_, radius)
            hit = np.unpackbits(got.view(np.uint8), bitorder="little")[:n]
            want = (bits[:, :n] != bits[:, d:]).sum(0) <= radius
            assert (hit == want).all()


def test_pigeonhole_finds_every_small_difference():
    masks = [m for (m,) in simhash.pigeonhole()]
    rng = random.Random(4)
    for _ in range(300):
        bits = rng.sample(range(64), 3)
        diff = sum(1 << b for b in bits)
        hit = [m for m in masks if not diff & (m % (1 << 64))]
        assert hit
        for m in hit:                                  # and the finer keys of each bucket
            free = [b for b in range(64) if not (m >> b) & 1]
            assert any(not diff & f for f in simhash.cut_mask(free))


def test_near_copies_leave_one(spark):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(3000)]
    base = [[rng.choice(vocab) for _ in range(300)] for _ in range(30)]
    rows = [(k, " ".join(w), "s") for k, w in enumerate(base)]
    for k, w in enumerate(base[:20]):
        v = list(w)
        v[rng.randrange(300)] = "changed"
        rows.append((100 + k, " ".join(v), "s"))
    rows += [(None, "no key at all", "s"), (500, None, "s")]
    kept = [r["doc_id"] for r in simhash.keep_one(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([*range(30), None, 500], key=str)
    assert simhash.keep_one(table(spark, [])).count() == 0


def similarity(a, b, words=5):
    sets = [{tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))}
            for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def classes_by_all_pairs(texts, least=0.8):
    root = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and root[a] != root[b] and similarity(texts[a], texts[b]) >= least:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if r == old else r for k, r in root.items()}
    return root


@pytest.mark.parametrize("group", [1024, 8])
def test_near_copies_by_exact_similarity(spark, group):
    rng = random.Random(21)
    vocab = [f"v{k}" for k in range(9000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = {}
    for k in range(60):                         # pairs on both sides of 0.8
        base = draw(300)
        texts[10 * k] = " ".join(base)
        tail = round(296 * (1 - s) / (1 + s)) if (s := rng.uniform(0.66, 0.92)) else 0
        texts[10 * k + 1] = " ".join(base[:300 - tail] + draw(tail))
    passage = draw(240)                         # a family that shares a passage only
    for k in range(12):
        texts[1000 + k] = " ".join(passage + draw(90))
    base = draw(200)                            # one large group of near copies
    for k in range(40):
        v = list(base)
        v[rng.randrange(200)] = f"changed{k}"
        texts[2000 + k] = " ".join(v)
    want = classes_by_all_pairs(texts)
    docs = table(spark, [(k, t, "s") for k, t in texts.items()])
    got = {r["doc_id"]: r["component_id"]
           for r in simhash.similar_classes(docs, group=group).collect()}
    assert got == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {k for k, r in want.items() if k == r}
    assert 10 < sum(k != r for k, r in want.items() if k < 1000) < 50
    assert all(want[k] == k for k in range(1000, 1012))


def test_repeats_do_not_count_for_near_copies(spark):
    rng = random.Random(22)
    vocab = [f"v{k}" for k in range(9000)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, base = draw(10) * 20, draw(300)
    texts = {k: " ".join(draw(210) + passage) for k in range(8)}        # unrelated
    texts[100] = " ".join(base + draw(10) * 40)     # near copies; other repeats in each
    texts[101] = " ".join(base + draw(10) * 40)
    assert similarity(texts[0], texts[1]) < 0.1 and similarity(texts[100], texts[101]) > 0.8
    kept = {r["doc_id"] for r in simhash.keep_one(
        table(spark, [(k, t, "s") for k, t in texts.items()])).collect()}
    assert kept == {*range(8), 100}


# ---------------------------------------------------------------- exact dedup


ROWS = [(1, "Same Text", "a"), (5, "same text", "b"), (3, "SAME TEXT", None), (2, None, "a"),
        (4, "", "a"), (None, "Ä", "a"), (7, "ä", "a"), (7, "twice", "a"), (7, "twice", "a"),
        (None, "only null", "a"), (9, "x" * 200_000, "a"), (8, "X" * 200_000, "a")]


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, tmp_path, weak):
    path = str(tmp_path / "docs")
    table(spark, ROWS).repartition(3).write.parquet(path)
    digest = (lambda t: F.substring(F.sha2(t, 256), 1, 0)) if weak else exact_dedup.digest
    found = exact_dedup.groups(spark.read.parquet(path), digest=digest).collect()
    sizes = Counter(lower(t) for _, t, _ in ROWS)
    best = {}
    for k, t, _ in ROWS:
        best[lower(t)] = max((best.get(lower(t)), k), key=lambda v: -1 if v is None else v)
    assert sorted(r["group_size"] for r in found) == sorted(sizes[lower(t)] for _, t, _ in ROWS)
    assert sorted(str(r["keep_id"]) for r in found) == sorted(
        str(best[lower(t)]) for _, t, _ in ROWS)
    assert sum(r["kept"] for r in found) == len(sizes)


def test_exact_keep_one(spark, tmp_path):
    path = str(tmp_path / "docs")
    table(spark, ROWS).write.parquet(path)
    from_files, in_memory = spark.read.parquet(path), table(spark, ROWS)
    for docs in (from_files, in_memory):
        kept = exact_dedup.keep_one(docs)
        assert kept.columns == docs.columns
        got = Counter((r["doc_id"], (r["text"] or "")[:9]) for r in kept.collect())
        assert sum(got.values()) == 7 and got[5, "same text"] == 1 and got[7, "twice"] == 1
    assert exact_dedup.keep_one(table(spark, [])).count() == 0


def test_state_goes_on(spark, tmp_path):
    folder, state = str(tmp_path / "prints"), str(tmp_path / "state")
    schema = "digest string, entry struct<id: long, place: struct<file: string, row: long>>"
    one = spark.createDataFrame([("d", (1, ("f", 0))), ("e", (2, ("f", 1)))], schema)
    one.write.parquet(folder)
    first = {r["digest"]: r["copies"] for r in exact_dedup.fold(
        spark, folder, one.schema, state, files_per_batch=1).collect()}
    assert first == {"d": 1, "e": 1}
    spark.createDataFrame([("d", (9, ("g", 0)))], schema).write.mode("append").parquet(folder)
    then = {r["digest"]: r for r in exact_dedup.fold(spark, folder, one.schema, state).collect()}
    assert then["d"]["copies"] == 2 and then["d"]["entry"]["id"] == 9


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights, share=1.5, most=2.0):
    """Share by weight, cap, share the excess again."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in sizes)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_targets(spark):
    rng = random.Random(6)
    for trial in range(4):
        sizes = {f"s{k}": rng.choice([0, 3, 50, 1000, 20_000]) + 1 for k in range(9)}
        sizes[None] = 400
        docs = spark.createDataFrame([(s, n) for s, n in sizes.items()],
                                     "source string, size long")
        order = sorted((s for s in sizes if s is not None)) + [None]
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        got = {r["source"]: r["target"] for r in mixing.target_sizes(
            mixing.repeating_weights(docs, (5, 2, 1))).collect()}
        assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes, weights).items()}


def test_mix(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), f"s{k % 4}" if k % 11 else None)
            for k in range(3000)]
    docs = mixing.word_counts(table(spark, rows), out="n").drop("copies")
    targets = mixing.target_sizes(mixing.repeating_weights(docs, (5, 2, 1), size="n"))
    taken = mixing.mix(docs, targets, size="n", block=64)
    got = taken.collect()
    assert len(got) == len(rows) and taken.columns == [*docs.columns, "copies"]
    want = {r["source"]: (r["target"], r["source_size"]) for r in targets.collect()}
    for s, (target, size) in want.items():
        words = sum(r["n"] * r["copies"] for r in got if r["source"] == s)
        assert abs(words - target) <= 300
        rate = target / size
        assert all(int(rate) <= r["copies"] <= int(rate) + 1 for r in got if r["source"] == s)
    again = mixing.mix(docs.repartition(7), targets, size="n", block=64).collect()
    assert {r["doc_id"]: r["copies"] for r in got} == {r["doc_id"]: r["copies"] for r in again}
    assert mixing.mixed_documents(table(spark, [])).count() == 0
    repeats = mixing.mixed_documents(table(spark, rows))
    assert repeats.columns == SCHEMA.replace(",", "").split()[::2]


def test_meetings_keep_mass_and_probability():
    rng = random.Random(8)
    for _ in range(500):
        p, q, a, b = rng.random(), rng.random(), rng.randint(1, 9), rng.randint(1, 9)
        mean = np.zeros(2)
        for u in np.linspace(0.0005, 0.9995, 1000):
            x, y = mixing.settle(p, a, q, b, u)
            assert x in (0, 1) or y in (0, 1)
            assert x * a + y * b == pytest.approx(p * a + q * b)
            mean += (x, y)
        assert mean / 1000 == pytest.approx((p, q), abs=0.01)


# ---------------------------------------------------------------- sharding


def test_shards_are_gapless_and_even(spark):
    rows = ([(k, f"t{k}", "s") for k in range(700)] + [(None, "x", "s")] * 40
            + [(5, "copy", None)] * 300)
    for docs, n in ((table(spark, rows), len(rows)), (table(spark, []), 0)):
        got = sharding.assign(docs, 24).collect()
        assert len(got) == n
        slots = {}
        for r in got:
            slots.setdefault(r["shard"], []).append(r["slot"])
        counts = [len(slots.get(s, [])) for s in range(24)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_overflow_goes_clockwise():
    moves = sharding.overflow([5, 0, 1, 0], [0, 1, 2, 1], [2, 2, 2])
    assert moves == [(0, 0, 2, 0), (2, 0, 1, 2), (0, 2, 4, 1), (0, 4, 5, 2)]


def test_one_more_shard_moves_little(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"))
    one = {r["doc_id"]: r["shard"] for r in sharding.assign(ids, 24).collect()}
    two = {r["doc_id"]: r["shard"] for r in sharding.assign(ids, 25).collect()}
    moved = sum(one[k] != two[k] for k in one) / len(one)
    assert moved < 0.35             # a new hash of all would move 96 %


# ---------------------------------------------------------------- url filter


def test_url_rules(spark):
    urls = [(1, "https://A.Example.ORG/en/12?x#y"), (2, "http://example.org/es/"), (3, None),
            (4, "no scheme"), (5, "x://org"), (6, "x://org/"), (7, "http://b.com/de/1"),
            (8, "http://notorg/"), (9, "a://b://c.com/fr/"), (None, "http://u.com/fr/x"),
            (10, "http://h?q=://z.org/"), (11, "ftp://" + "a" * 50_000 + ".net/p")]
    pages = spark.createDataFrame([(*r, "h") for r in urls], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, labels).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("example.org", "/es/", "example.org/es/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("org", "", None, "allow") and got[6] == ("org", "/", "org/", "allow")
    assert got[7][2:] == ("com/de/", "block") and got[8][2] is None
    assert got[9] == ("b:", "//c.com/fr/", None, "allow")
    assert got[None][2:] == ("com/fr/", "allow") and got[10][:2] == ("h", "")
    assert len(got) == len(urls)
    assert url_filter.judge(pages.where("false"), labels).count() == 0


def test_bad_templates_are_blocked(spark):
    rows, labels = [], []
    for k in range(120):
        rows.append((k, f"http://one.net/shop/{k}.html"))
        rows.append((1000 + k, f"http://one.net/news/item{chr(97 + k % 26)}{k}"))
        rows.append((2000 + k, f"http://two.net/shop/{k}.html"))
        if k % 2:
            labels += [(k, 0, 0), (1000 + k, 1, 0), (2000 + k, 1, None)]
    labels += [(1, 1, 1), (None, 0, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, said).collect()}
    assert {got[k] for k in range(120)} == {"block"}
    assert {got[k] for k in range(1000, 1120)} | {got[k] for k in range(2000, 2120)} == {"allow"}


def test_deep_branches_are_told_apart(spark):
    rows = [(1000 * b + k, f"http://one.net/2020/01/05/shop/{name}/x/{k}")
            for b, name in enumerate(("spam", "news")) for k in range(60)]
    labels = [(i, int(i >= 1000), 0) for i, _ in rows if i % 2]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(
        spark.createDataFrame(rows, "page_id long, url string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {got[k] for k in range(60)} == {"block"}
    assert {got[1000 + k] for k in range(60)} == {"allow"}


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    vocab = [f"word{k}" for k in range(4000)]
    rows = []
    for k in range(60):
        w = [rng.choice(vocab) for _ in range(200)]
        rows.append((k, " ".join(w), "en", f"s{k % 3}", 1))
        if k < 10:
            rows.append((100 + k, " ".join(w).upper(), "en", f"s{k % 3}", 1))
        if 10 <= k < 20:
            w[7] = "other"
            rows.append((200 + k, " ".join(w), "en", f"s{k % 3}", 1))
    rows += [(300 + k, "too short", "en", "s0", 1) for k in range(5)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = [70 + 10, 70, 60]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < len(want):
            assert docs.count() == want[k], name
        if k == 3:
            copies = Counter(r["doc_id"] for r in docs.collect())
            assert max(copies.values()) <= 2
    assert docs.columns == ["doc_id", "ids"] and docs.count() == sum(copies.values())
    assert quality.keep_good(spark.read.parquet(str(tmp_path / "stage0"))).count() == want[0]
