"""Spelling variants, near copies by odd sketches and collocations against brute force."""

import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import collocations, minhash, spelling

CLASHING = "doc_id long, text string, lang string, key string, word string, n string, id string"


def clash(rows):
    """Rows ``doc_id, text, lang`` with columns named like those used inside."""
    return [(*r, "key", "word", "n", "id") for r in rows]


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


# ---------------------------------------------------------------- spelling


def words_by_hand(rows, every):
    found = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(rows, every=97):
    n = words_by_hand(rows, every)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None)
            for w in n}


def misspelt():
    draw = random.Random(2)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(4, 9))) for _ in range(50)]
    base += ["x" * 70 + "q" * 30, "ab" * 100, "ÀÖØ×÷ÿ"]

    def edited(w):
        k, i, c = draw.random(), draw.randrange(len(w)), draw.choice("abcdéÿ")
        return (w if k < .5 else w[:i] + w[i + 1:] if k < .65
                else w[:i] + c + w[i + (k > .8):])

    texts = [" ".join(edited(draw.choice(base)) for _ in range(150)) for _ in range(90)]
    texts += [t.upper() for t in texts[:5]] + [None, "", "1 2 3", texts[0], texts[0]]
    return [(k if k % 7 else None, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("given", [{}, {"symbols": 2}, {"symbols": 16, "every": 5}])
def test_variants(spark, given):
    rows = misspelt()
    docs = spark.createDataFrame(clash([(k, t, "en") for k, t in rows]), CLASHING).repartition(5)
    got = [tuple(r) for r in spelling.variants(docs, **given).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()]
    want = variants_by_hand(rows, given.get("every", 97))
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] != r[2] for r in want if r[1])


def test_variants_of_nothing(empty):
    assert spelling.variants(empty).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty, ratio=1)


def test_reduced_neighbours_are_whole():
    draw, symbols = random.Random(3), 4
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    rows = spelling.reduced(words, symbols)
    who, key = spelling.smaller_neighbours(rows, symbols)
    assert len(set(zip(who.tolist(), key.tolist()))) == len(who)
    own = dict(zip(map(tuple, rows.tolist()), spelling.own_keys(rows).tolist()))
    sent = defaultdict(set)
    for w, k in zip(who.tolist(), key.tolist()):
        sent[tuple(rows[w].tolist())].add(k)
    for a in own:
        for b in own:
            if sum(x != y for x, y in zip(a, b)) <= 1:
                assert own[b] in sent[a] or own[a] in sent[b]


# ---------------------------------------------------------------- near copies


def shingles_by_hand(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def classes_by_hand(rows):
    sets = [shingles_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (k, _), r in zip(rows, root):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted(((k, len(s), least.get(r) if s else k,
                    k == (least.get(r) if s else k)) for (k, _), s, r in zip(rows, sets, root)),
                  key=repr)


def copies():
    draw = random.Random(4)
    rows = []
    for size in (1, 2, 3, 9, 40, 300):
        for _ in range(12):
            words = [draw.choice("abcdefghijklmnop") * draw.randint(1, 6) for _ in range(size)]
            rows.append(" ".join(words))
            for share in (0.02, 0.05, 0.08, 0.1, 0.12, 0.2):
                other = [f"w{draw.random()}" if draw.random() < share else w for w in words]
                rows.append("\t".join(other).upper())
    rows += [None, "", " \n", "one", "ONE", "one", rows[0], rows[0]]
    rows += ["common boiler plate line " * 40 + " ".join(f"{k}x{j}" for j in range(4))
             for k in range(40)]
    keys = [k if k % 11 else None for k in range(len(rows))]
    return list(zip(keys, rows))


@pytest.mark.parametrize("given", [{}, {"bucket": 6, "block_shingles": 700}])
def test_near_copies(spark, given):
    rows = copies()
    docs = spark.createDataFrame(clash([(k, t, "en") for k, t in rows]), CLASHING).repartition(5)
    got = minhash.near_copies(docs, **given)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == classes_by_hand(rows)


def test_near_copies_of_nothing(empty):
    assert minhash.near_copies(empty).collect() == []


def test_repeated_keys_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "A b c"), (2, "A b c")],
                                 "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_copies(docs).collect())) == [
        (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]


def test_sketch_estimates_and_bands_find():
    """Pairs just above 0.8: sketches let all pass, bands miss next to none; at 0.3 sketches
    let none pass."""
    factor, mask, salt = minhash.constants()
    draw = np.random.RandomState(5)

    def pair(size, similar):
        common = int(np.ceil(2 * size * similar / (1 + similar)))
        base = draw.randint(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        return [minhash.samples(part, factor, mask) for part in (base[:size], base[-size:])]

    most, missed, close = minhash.most_bits(0.8), 0, 0
    for size in (5, 40, 400):
        for _ in range(200):
            a, b = pair(size, 0.8)
            missed += not (minhash.band_keys(a, salt) == minhash.band_keys(b, salt)).any()
            assert odd_bits(a, b, salt) <= most
            close += odd_bits(*pair(size, 0.3), salt) <= most
    assert missed <= 1 and close <= 3


def odd_bits(a, b, salt):
    return int(np.bitwise_count(minhash.odd_sketch(a, salt) ^ minhash.odd_sketch(b, salt)).sum())


# ---------------------------------------------------------------- collocations


def phrases_by_hand(rows, most_words=3, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for s in range(1, most_words + 1):
                f[lang].update(tuple(w[i:i + s]) for i in range(len(w) - s + 1))
    out = set()
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        got = []
        for p, a in often.items():
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]])
                                 for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= cover * a and p in {
                    q[i:i + len(p)] for i in range(len(q))} for q, b in often.items()):
                got.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(got)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return out


def talk():
    draw = random.Random(1)
    words = ["a", "B", "été", "the", "of", "x\u0085", "\x01q", "new", "york", "\x00en"]
    rows = [(draw.choice(["en", "fr", None, "und"]), "".join(
        draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n"])
        for _ in range(draw.randint(0, 80)))) for _ in range(200)]
    return rows + [("en", None), (None, ""), ("en", "new york city " * 3000), rows[0]]


@pytest.mark.parametrize("given, ranges", [
    ({}, 4096), ({"range_bytes": 2000, "shard": 97}, 4096),
    ({"range_bytes": 2000, "shard": 97, "most_words": 4, "least": 5, "top": 50}, 3)])
def test_collocations(spark, monkeypatch, given, ranges):
    monkeypatch.setattr(collocations, "MOST_RANGES", ranges)
    rows = talk()
    docs = spark.createDataFrame(clash([(1, t, lang) for lang, t in rows]),
                                 CLASHING).repartition(5)
    got = collocations.collocations(docs, **given)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_by_hand(rows, given.get("most_words", 3), given.get("least", 10),
                           top=given.get("top", 2000))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) and set(got) == want


def test_places_spread_the_paths(spark):
    docs = spark.createDataFrame([(t, lang or "und") for lang, t in talk() if t],
                                 "text string, lang string")
    where = collocations.places(docs, 4000)
    parts = collocations.shards(docs.repartition(3), where, 3, 500).groupBy("place").count()
    assert len(where.bounds) > 5 and parts.count() > len(where) // 2


def test_collocations_of_nothing(empty):
    assert collocations.collocations(empty).collect() == []


def test_automaton_round_trip_and_composition():
    draw = np.random.RandomState(6)
    names = [b"\xff", b"\x00en", *[b"w%02d" % k for k in range(60)]]
    ids = draw.randint(2, 62, 4000)
    ids[draw.randint(0, 4000, 300)] = collocations.NO_WORD
    paths = collocations.counted(np.ones(4000, np.int64), ids, 4000, names, 3)
    packed = collocations.to_automaton(paths)
    back = collocations.from_automaton(packed)
    twice = collocations.united([paths, back])
    want = Counter()
    for i in range(4000):
        for s in range(1, 4):
            part = ids[i:i + s]
            if len(part) == s and (part >= 0).all():
                want[tuple(part)] += 1
    asked = [(b"\x00en", *[names[k] for k in p]) for p in want] + [
        (b"\x00en", b"zz"), (b"\x00fr", b"w01"), (b"\x00en",)]
    counts = [*want.values(), 0, 0, int((ids >= 0).sum())]
    assert collocations.composed(back, asked).tolist() == counts
    assert collocations.composed(twice, asked).tolist() == [2 * n for n in counts]
    # equal tails are one state
    tails = sum(len(np.unique(level[0])) for level in paths.levels[1:])
    states = sum(len(sizes) for sizes, *_ in pickle.loads(packed)[1])
    assert 2 * states < tails


def test_one_shingle_set_at_a_time(spark, monkeypatch):
    """A batch of texts does not hold the shingle sets of all of them."""
    import weakref

    import pyarrow as pa

    from tallyloom.llm import simhash

    class Texts:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.RecordBatch.from_arrays(
                [pa.array(range(50)), pa.array(range(50)),
                 pa.array([f"a b c d e f {k}" for k in range(50)])],
                ["key", "hash", "text"])])))

    real, alive, most = simhash.shingle_set, weakref.WeakSet(), []

    class Counted(np.ndarray):
        __hash__ = object.__hash__
        __eq__ = object.__eq__

    def counted(text, words):
        found = real(text, words).view(Counted)
        alive.add(found)
        most.append(len(alive))
        return found

    monkeypatch.setattr(simhash, "shingle_set", counted)
    (out,) = simhash.set_prints(Texts(), key="doc_id", text="text", words=5, lanes=4)
    assert len(most) == 50 and max(most) <= 2
    sets = [real(f"a b c d e f {k}", 5) for k in range(50)]
    assert out.column("id").to_pylist() == [simhash.set_id(s) for s in sets]
    assert [list(r) for r in zip(*[out.column(f"f{k}").to_pylist() for k in range(4)])] == [
        simhash.majority([s], 4) for s in sets]
