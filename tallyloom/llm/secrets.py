"""Secrets in texts: fixed patterns, and strings that look random.

Three fixed kinds are always reported.  Beyond them, long strings of an encoding's
characters go through a battery of tests.  The encoding is inferred from the characters
used.  Each test is read in two ways:

* against randomness: chi-squared uniformity, runs above and below the middle of the
  alphabet and serial correlation must all agree with it;
* against structure: the null model is text as the corpus has it in its shorter strings,
  by the shares of their characters and the chances of one character after another.  Equal
  characters (the chi-squared sum), runs, and the serial association of neighbours are
  held against what structured strings of that length show, as normal deviates; their mean
  is a deviate however they hang together, and gives the p-value.

The p-values of all candidates of the corpus are held against the false-discovery rate
within each class of length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .base import let, small, text_of

BASE = ("assign", "access", "hex")

# The patterns, and the length a match must have (of its last group).
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
ALL = UPPER + LOWER + DIGITS + "+/-_"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{2,19}+(?![A-Za-z0-9+/_-])"
ENCODINGS = {               # the first that has all characters of a string
    "digits": ("[0-9]+", DIGITS),
    "lower": ("[a-z]+", LOWER),
    "upper": ("[A-Z]+", UPPER),
    "hex": ("[0-9a-f]+", DIGITS + "abcdef"),
    "upper_hex": ("[0-9A-F]+", DIGITS + "ABCDEF"),
    "base32": ("[A-Z2-7]+", UPPER + "234567"),
    "base36": ("[a-z0-9]+", LOWER + DIGITS),
    "base62": ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS),
    "base64": (".*", UPPER + LOWER + DIGITS + "+/-_"),
}
UNSEEN = 0.1                # share of structure that follows no rule of its neighbours
AGREE = 3.3                 # largest z of a uniformity test that still agrees
RATE = 0.01                 # false discoveries allowed among the strings reported
BINS = 150                  # of -10 log10 p


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Matches as ``(start, end, text)`` in characters, end exclusive; those whose group is
    shorter than ``least`` are left out, and not tried again.

    What lies between the matches and the matches themselves add up to the offsets.
    """
    def placed(found: Column) -> Column:
        def at(gaps: Column) -> Column:
            def length(items: Column, n: Column) -> Column:
                return F.aggregate(F.slice(items, F.lit(1), n), F.lit(0),
                                   lambda a, x: a + F.length(x))
            return F.transform(found, lambda m, k: let(
                length(gaps, k + 1) + length(found, k), lambda s: F.struct(
                    s.alias("start"), (s + F.length(m)).alias("end"), m.alias("text"))))
        return let(F.split(text, pattern, -1), at)

    whole = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if least:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        whole = let(groups, lambda g: F.filter(
            whole, lambda m, k: F.length(F.get(g, k)) >= least))
    none = F.array().cast("array<struct<start: int, end: int, text: string>>")
    return F.when(F.rlike(text, F.lit(pattern)), whole).otherwise(none)


def normal_of_chi(chi: Column, free: Column) -> Column:
    """Chi-squared as a normal deviate, by its cube root."""
    part = 2 / (9 * free)
    return (F.pow(chi / free, F.lit(1 / 3)) - 1 + part) / F.sqrt(part)


def normal_tail(z: Column) -> Column:
    """Probability of a normal deviate above ``z``; within 0.3 per cent."""
    def above(x: Column) -> Column:
        return F.exp(-x * x / 2) / (1.64 * x + F.sqrt(0.76 * x * x + 4))
    return F.greatest(F.lit(1e-300), F.when(z >= 0, above(z)).otherwise(1 - above(-z)))


class Structure:
    """The null model: what structured strings of the corpus show.

    ``score`` has, for two characters in a row, the log of the chance of the second after
    the first over that of a random one; ``mean``, ``spread`` and ``between`` are its mean,
    its variance from place to place, and that of the means of strings.  Per encoding there
    are the sums of squared and cubed shares of characters, and the chance of a new run.
    """

    def __init__(self, pairs: np.ndarray):
        n, size = pairs.sum(), len(ALL)
        after = (pairs + 1) / (pairs.sum(axis=1, keepdims=True) + size)
        self.score = np.log2(size * ((1 - UNSEEN) * after + UNSEEN / size))
        self.mean = float((pairs * self.score).sum() / n) if n else 0.0
        square = float((pairs * self.score**2).sum() / n) if n else 0.0
        self.spread, self.between = max(square - self.mean**2, 1e-3), 0.0
        self.squares, self.cubes, self.turns = [], [], []
        for _, letters in ENCODINGS.values():
            at = [ALL.index(c) for c in letters]
            share = pairs[at].sum(axis=1) + 1.0
            share /= share.sum()
            high = np.arange(len(at)) > (len(at) - 1) / 2
            among = pairs[np.ix_(at, at)] + 1.0
            self.squares.append(float((share**2).sum()))
            self.cubes.append(float((share**3).sum()))
            self.turns.append(float(among[high[:, None] != high].sum() / among.sum()))

    def scores(self) -> Column:
        return F.split(F.lit(",".join(f"{v:.5f}" for v in self.score.ravel())), ",").cast(
            "array<double>")


def string_score(chars: Column, n: Column, scores: Column) -> Column:
    """Mean score of neighbours."""
    at = F.transform(chars, lambda c: F.instr(F.lit(ALL), c) - 1)
    return let(at, lambda x: total(F.sequence(F.lit(1), n - 1), lambda i: F.get(
        scores, F.get(x, i - 1) * len(ALL) + F.get(x, i))) / (n - 1))


def structure(docs: DataFrame, *, text: str = "text") -> Structure:
    """The null model from all strings of 2 to 19 characters of all texts; candidates are
    longer.  Strings are counted first, so the driver gets one number per pair of
    characters, and pairs are counted once per distinct string."""
    found = F.regexp_extract_all(text_of(text), F.lit(TOKEN), F.lit(0))
    tokens = staged(docs.select(F.explode(found).alias("t")).groupBy("t").agg(
        F.count("*").alias("n")))
    two = F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring("t", i, 2))
    pairs = np.zeros((len(ALL), len(ALL)))
    for r in tokens.select("n", F.explode(two).alias("p")).groupBy("p").agg(
            F.sum("n").alias("n")).collect():
        pairs[ALL.index(r["p"][0]), ALL.index(r["p"][1])] = r["n"]
    model = Structure(pairs)
    long = tokens.where(F.length("t") >= 5).select("n", F.length("t").alias("k"), string_score(
        F.split("t", ""), F.length("t"), model.scores()).alias("m"))
    n = F.sum("n")
    first = long.agg((F.sum(F.col("n") * F.col("m")) / n).alias("m"),
                     (F.sum(F.col("n") * F.col("m") * F.col("m")) / n).alias("mm"),
                     (F.sum(F.col("n") / (F.col("k") - 1)) / n).alias("inverse")).first()
    if first["m"] is not None:
        model.between = max(0.0, first["mm"] - first["m"]**2 - model.spread * first["inverse"])
    return model


def total(items: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + value(x))


def tested(string: Column, model: Structure) -> Column:
    """Tests of one string: ``(chi, runs, serial, p)``; null where no encoding fits."""
    body = F.rtrim(string, F.lit("="))
    kind = F.lit(None).cast("struct<letters: string, squares: double, cubes: double, "
                            "turns: double>")
    for k, (pattern, letters) in reversed(list(enumerate(ENCODINGS.values()))):
        kind = F.when(F.rlike(body, F.lit(f"^(?:{pattern})$")), F.struct(
            F.lit(letters).alias("letters"), F.lit(model.squares[k]).alias("squares"),
            F.lit(model.cubes[k]).alias("cubes"), F.lit(model.turns[k]).alias("turns"))
        ).otherwise(kind)

    def battery(s: Column, kind: Column) -> Column:
        letters = kind["letters"]

        def of(chars: Column, n: Column, k: Column) -> Column:
            squares = total(F.array_distinct(chars), lambda c: F.pow(
                (n - F.length(F.replace(s, c))).cast("double"), F.lit(2.0)))
            indexes = F.transform(chars, lambda c: (F.instr(letters, c) - 1).cast("double"))
            return let(squares, lambda q: let(indexes, lambda x: rest(
                chars, n, k, normal_of_chi(q * k / n - n, k - 1), q, x)))

        def rest(chars, n, k, chi, squares, x):
            # sums used inside other sums are bound first, or they would be taken per item
            middle = (k - 1) / 2
            pairs = F.sequence(F.lit(1), n - 1)
            runs = 1 + total(pairs, lambda i: (
                (F.get(x, i) > middle) != (F.get(x, i - 1) > middle)).cast("double"))
            high = total(x, lambda v: (v > middle).cast("double"))
            run_z = lambda r: let(high, lambda h: let(
                2 * h * (n - h) / n + 1, lambda e: F.try_divide(
                    r - e, F.sqrt((e - 1) * (e - 2) / (n - 1)))))
            serial = let(total(x, lambda v: v) / n, lambda mean: F.try_divide(
                total(pairs, lambda i: (F.get(x, i) - mean) * (F.get(x, i - 1) - mean)),
                total(x, lambda v: (v - mean) * (v - mean))))
            return let(runs, lambda r: F.struct(
                chi.alias("chi"),
                F.coalesce(run_z(r), F.lit(99.0)).alias("runs"),
                F.coalesce(serial * F.sqrt(n.cast("double")), F.lit(99.0)).alias("serial"),
                normal_tail(apart(chars, n, squares, r)).alias("p")))

        def apart(chars, n, squares, runs):
            """How far the three tests lie from structure, towards randomness."""
            s2, s3, turns = kind["squares"], kind["cubes"], kind["turns"]
            score, n = string_score(chars, n, model.scores()), n.cast("double")
            # pairs of equal characters anywhere in the string
            equal = (squares - n) / 2
            pairs = n * (n - 1) / 2
            chi = (pairs * s2 - equal) / F.sqrt(
                pairs * (s2 - s2 * s2) + 2 * pairs * (n - 2) * F.greatest(s3 - s2 * s2, F.lit(0.0)))
            # random strings begin a new run at every second place
            more = (runs - 1 - (n - 1) * turns) / F.sqrt((n - 1) * turns * (1 - turns))
            serial = (model.mean - score) / F.sqrt(
                model.spread / (n - 1) + model.between)
            return (chi + F.when(turns < 0.5, more).otherwise(-more) + serial) / 3

        return let(F.split(s, ""), lambda chars: let(F.length(s), lambda n: let(
            F.length(letters), lambda k: of(chars, n, k))))

    return let(body, lambda s: let(kind, lambda k: battery(s, k)))


def length_class(length: Column) -> Column:
    """Half octaves from 20 characters on."""
    return F.floor(F.log2(length / 20.0) * 2).cast("int")


def p_bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(p)), F.lit(BINS)).cast("int")


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
         model: Structure | None = None) -> DataFrame:
    """``key, assign, access, hex, tried`` for every row: spans of the fixed kinds, and the
    tested candidates outside of those.  The model is that of the texts unless given."""
    model = model or structure(docs, text=text)
    t = text_of(text)
    found = docs.select(F.col(key).alias("key"), F.inline(F.array(F.struct(
        spans(t, ASSIGN, 2, 8).alias("assign"), spans(t, ACCESS, 0, 16).alias("access"),
        spans(t, HEX).alias("hex"), spans(t, CANDIDATE).alias("tried")))))

    def free(c: Column) -> Column:
        clash = F.lit(False)
        for kind in BASE:
            clash = clash | F.exists(kind, lambda b: (b["start"] < c["end"])
                                     & (c["start"] < b["end"]))
        return ~clash

    tried = F.transform(F.filter("tried", free), lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"),
        length_class(F.length(c["text"])).alias("class"), tested(c["text"], model).alias("test")))
    ends = lambda kind: F.transform(kind, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"))).alias(kind)
    return found.select(F.col("key").alias(key), *[ends(k) for k in BASE],
                        tried.alias("tried"))


def agrees(test: Column) -> Column:
    """No test of the battery speaks against randomness."""
    return ((test["chi"] < AGREE) & (F.abs(test["runs"]) < AGREE)
            & (F.abs(test["serial"]) < AGREE))


def thresholds(scanned: DataFrame, rate: float = RATE) -> DataFrame:
    """``class, least``: per class of length, the smallest bin of p-values that keeps the
    false-discovery rate.  All candidates of the corpus are counted, in at most a few
    thousand cells (classes of length grow with the logarithm)."""
    cells = (scanned.select(F.explode("tried").alias("c"))
             .where(agrees(F.col("c.test")))
             .groupBy(F.col("c.class").alias("class"), p_bin(F.col("c.test.p")).alias("bin"))
             .agg(F.count("*").alias("n")))
    whole = F.sum("n").over(Window.partitionBy("class"))
    upward = Window.partitionBy("class").orderBy(F.desc("bin"))
    false = whole * F.pow(F.lit(10.0), -F.col("bin") / 10)
    judged = cells.withColumn("fdr", false / F.sum("n").over(upward))
    return judged.where(F.col("fdr") <= rate).groupBy("class").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                 rate: float = RATE, stage=None, model: Structure | None = None) -> DataFrame:
    """``key, assign, access, hex, random`` for every row: arrays of ``(start, end)``.

    Without a ``model`` of structured text, it is made from the texts themselves, all of
    them; where they are so few that they show no structure, nothing is taken for random.

    A null text is an empty one and has none; null or repeated keys are passed on, each row
    by itself; other columns are not looked at; texts of any length are read whole; an
    empty table gives an empty result.  ``stage`` may write the scan, so that texts are
    read once.
    """
    scanned = scan(docs, key=key, text=text, model=model)
    scanned = stage(scanned) if stage else scanned
    # one row: a bin for each class that has one
    limits = small(thresholds(scanned, rate).agg(F.map_from_entries(F.collect_list(
        F.struct("class", "least"))).alias("m"))).select("m").scalar()
    good = F.filter("tried", lambda c: agrees(c["test"]) & F.coalesce(
        p_bin(c["test"]["p"]) >= F.try_element_at("_m", c["class"]), F.lit(False)))
    return scanned.withColumn("_m", limits).select(key, *BASE, F.transform(
        good, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))
    ).alias("random"))


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
        F.lit(kind).alias("kind")))


def digests(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Counts and texts of :func:`find_secrets`, spans by start, then kind as listed."""
    kinds = (*BASE, "random")

    def listed(*names: str) -> Column:
        every = F.flatten(F.array(*[_ranked(name, kinds.index(name)) for name in names]))
        return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(key, *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
                        F.sha2(listed(*BASE), 256).alias("base_sha256"),
                        listed(*kinds).alias("spans"))
