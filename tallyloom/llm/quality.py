"""Quality rules per document, and verdicts per host that tighten them.

Each document is measured and held against a few rules.  The failures are added up by
host (the table's ``source``), the hosts' failure rates are shrunk towards the corpus by
a beta prior estimated from all hosts, and hosts whose shrunk rate is too high are
rejected.  A rejected host's documents go when they fail a host-level rule themselves;
its clean documents stay, as do all documents that only fail such a rule elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import attach_row
from ..session import staged
from .base import SPACE, WORD, let, text_of, unused

MIN_WORDS = 50              # base rule: shorter documents fail
MAX_REPEAT_PCT = 50         # base rule: a larger share of repeated words fails
HOST_RATE = 0.5             # a host above this shrunk failure rate is rejected
PRIOR_STRENGTH = (1.0, 1000.0)      # limits of the prior's weight, in documents

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first one included.

    Windows are compared by 64-bit hashes, within one text.  A text without an equal pair
    is known by its number of distinct hashes; only the others are sorted.
    """
    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, k: F.struct(
            h.alias("h"), k.alias("k"))))

        def twice(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.array_sort(F.transform(
                F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["k"]))

        def length(at: Column) -> Column:
            steps = F.transform(at, lambda x, k: F.least(
                F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(placed, twice), length)

    last = F.size(words) - 3
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    return F.coalesce(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0))


def measures(text: Column) -> Column:
    """A struct of counts of one text; all zero for an empty one."""
    def of(words: Column, lines: Column) -> Column:
        parts = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
            "n_lines": F.size(lines)}
        return F.struct(*[v.cast("bigint").alias(k) for k, v in parts.items()])

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    return let(words, lambda w: let(lines, lambda x: of(w, x)))


def base_failed(m: Column) -> Column:
    return ((m["n_words"] < MIN_WORDS)
            | (100 * m["n_repeat_words"] > MAX_REPEAT_PCT * m["n_words"]))


def host_rules(m: Column) -> dict[str, Column]:
    """Milder rules, whose failures are added up by host."""
    n = m["n_words"]
    return {"few_words": n < MIN_WORDS,
            "symbols": 10 * m["n_symbols"] > n,
            "lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
            "repeats": 5 * m["n_repeat_words"] > n,
            "word_length": (m["word_chars"] < 3 * n) | (m["word_chars"] > 12 * n)}


def any_failed(m: Column) -> Column:
    failed = F.lit(False)
    for rule in host_rules(m).values():
        failed = failed | rule
    return failed


def measured(docs: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """``docs`` with a struct of its measures, computed once per row."""
    return docs.select("*", F.inline(F.array(F.struct(measures(text_of(text)).alias(out)))))


def host_rates(measured: DataFrame, host: str = "source", out: str = "measures") -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by a beta prior.

    The prior is fitted by the moments of the beta-binomial law.  Rates of hosts with ``n_i``
    of ``N`` documents, weighted by these, spread by ``mean (1 - mean)`` times ``k / N + rho
    (1 - k / N)`` for ``k`` hosts: the first part is chance alone, the second the hosts' own
    difference.  The prior weighs ``1 / rho - 1`` documents.  Where chance explains the
    spread, or no host has two documents, that is its greatest weight.  One shuffled row
    per host and task.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.count_if(any_failed(F.col(out))).alias("failed"))
    share = F.col("failed") / F.col("n")
    total = hosts.agg(F.sum("n").alias("all_n"), F.sum("failed").alias("all_failed"),
                      F.count("*").alias("hosts"),
                      F.sum(F.col("failed") * share).alias("squares"))
    mean = F.col("all_failed") / F.col("all_n")
    chance = F.col("hosts") / F.col("all_n")
    spread = F.try_divide(F.col("squares") / F.col("all_n") - mean * mean, mean * (1 - mean))
    rho = F.try_divide(spread - chance, 1 - chance)
    low, high = map(F.lit, PRIOR_STRENGTH)
    strength = F.when(rho > 1e-9, F.least(F.greatest(1 / rho - 1, low), high)).otherwise(high)
    prior = total.select(mean.alias("mean"), strength.alias("strength"))
    rate = ((F.col("failed") + F.col("mean") * F.col("strength"))
            / (F.col("n") + F.col("strength")))
    return attach_row(hosts, prior).select("host", "n", "failed", rate.alias("rate"))


def rejected_hosts(rates: DataFrame, limit: float = HOST_RATE) -> DataFrame:
    return rates.where(F.col("rate") > limit).select("host", "rate")


def judged(measured: DataFrame, rejected: DataFrame, host: str = "source",
           out: str = "measures", failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """Host verdicts joined back: adds ``base_failed`` and ``kept``.

    Only rejected hosts take part in the join, as a table whose size the planner knows; a
    null host is a host of its own.
    """
    side = unused(measured.columns, "_host")
    marked = measured.join(rejected.select(F.struct("host").alias(side)),
                           measured[host].eqNullSafe(F.col(f"{side}.host")), "left")
    m = F.col(out)
    bad = F.col(side).isNotNull() & any_failed(m)
    return marked.withColumns({failed: base_failed(m), kept: ~(base_failed(m) | bad)}).drop(side)


def keep_good(docs: DataFrame, *, host: str = "source", text: str = "text",
              limit: float = HOST_RATE) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are measured once, in a pass that writes them with their measures; a second pass
    over that table, with one row per host between them, judges.  No text is shuffled.  A
    null text is an empty one, which fails; repeated rows are judged alike; an empty table
    stays empty; further columns, whatever their names, are kept.
    """
    names = [unused(docs.columns, n) for n in ("_measures", "_failed", "_kept")]
    m = staged(measured(docs, text, names[0]))
    rejected = staged(rejected_hosts(host_rates(m, host, names[0]), limit))
    verdicts = judged(m, rejected, host, *names)
    return verdicts.where(F.col(names[2])).select(*docs.columns)


def report(docs: DataFrame, *, key: str = "doc_id", host: str = "source", text: str = "text",
           limit: float = HOST_RATE, stage=None) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``; cases as in
    :func:`keep_good`.  ``stage`` may write the narrow measures, so texts are read once."""
    m = measured(docs.select(F.col(key).alias("_key"), F.col(host).alias("_source"),
                             F.col(text).alias("_text")), "_text").drop("_text")
    m = stage(m) if stage else m
    rejected = staged(rejected_hosts(host_rates(m, "_source"), limit))
    return judged(m, rejected, "_source").select(
        F.col("_key").alias(key), "measures.*", "base_failed", "kept").drop("n_lines")
