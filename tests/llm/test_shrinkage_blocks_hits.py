"""Host priors, blocks of the mixing tree, and the check of exact dedup on hits only."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, mixing, quality


def rates(spark, hosts):
    """Host rates for ``(documents, failures)`` of each host."""
    rows = [(f"h{i:04d}", j < f) for i, (n, f) in enumerate(hosts) for j in range(n)]
    docs = spark.createDataFrame(rows, "source string, bad boolean")
    # one mild rule fails: too many symbols
    words = [f"word{k}" for k in range(60)]
    text = F.when(F.col("bad"), F.lit(" # ".join(words))).otherwise(F.lit(" ".join(words)))
    m = quality.measured(docs.select("source", F.concat(
        text, F.monotonically_increasing_id().cast("string")).alias("text")))
    return {r["host"]: r["rate"] for r in quality.host_rates(m).collect()}


def test_single_documents_do_not_reject_their_hosts(spark):
    """Hosts of one document each say nothing about how hosts differ."""
    found = rates(spark, [(1, k < 100) for k in range(1000)])
    assert len(found) == 1000 and max(found.values()) < 0.11


def test_hosts_alike_shrink_and_hosts_apart_do_not(spark):
    draw = random.Random(1)
    alike = [(n, sum(draw.random() < 0.3 for _ in range(n))) for n in
             (draw.randint(1, 12) for _ in range(300))]
    found = rates(spark, alike)
    assert max(found.values()) < 0.45
    apart = [(20, 18)] * 30 + [(20, 2)] * 70
    found = rates(spark, apart)
    mean, s = 0.34, (30 * (.9 - .34) ** 2 + 70 * (.1 - .34) ** 2) / 100 / (.34 * .66)
    strength = max(1.0, 1 / ((s - 0.05) / 0.95) - 1)
    assert found["h0000"] == pytest.approx((18 + mean * strength) / (20 + strength), abs=1e-9)
    assert rates(spark, [(5, 5)] * 4)["h0000"] == pytest.approx(1.0)


@pytest.mark.parametrize("block", [2, 4, 8, 512])
def test_many_size_classes_end(spark, block):
    """Fourteen sizes, each of its own class, in one source: a level always settles some."""
    rows = [(k, "a", 2 ** (k % 14)) for k in range(56)] + [(99, None, 5), (98, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    total = sum(n for _, s, n in rows if s == "a")
    targets = spark.createDataFrame([("a", total, 0.37 * total), (None, 5, 10.0)],
                                    "source string, source_size long, target double")
    taken = {r["doc_id"]: r["copies"] for r in
             mixing.mix(docs, targets, size="n", block=block).collect()}
    mass = sum(taken[k] * n for k, s, n in rows if s == "a")
    assert abs(mass - 0.37 * total) < 2 ** 13 and taken[99] == 2 and taken[98] == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, targets, size="n", block=1)


def test_expected_copies_are_the_rate(spark):
    """Over many draws, every size class is taken at the rate of its source."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("a").alias("source"),
        (F.pow(F.lit(3), F.col("id") % 4) * 10).cast("long").alias("n"))
    total = docs.agg(F.sum("n")).first()[0]
    targets = spark.createDataFrame([("a", total, 1.4 * total)],
                                    "source string, source_size long, target double")
    for seed in (1, 2):
        found = mixing.mix(docs, targets, size="n", block=16, seed=seed).groupBy("n").agg(
            F.avg("copies").alias("m")).collect()
        assert all(abs(r["m"] - 1.4) < 0.06 for r in found)


def test_single_texts_stay_out_of_the_check(spark):
    rows = [(k, f"text {k % 700}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digests = docs.select(F.sha2("text", 256).alias("digest"))
    hits = digests.groupBy("digest").count().where("count > 1").select("digest")
    passed = digests.where(exact_dedup.may_hit(F.col("digest"), hits))
    assert passed.join(hits, "digest", "left_semi").count() == 600
    assert passed.count() <= 604
    none = digests.where(exact_dedup.may_hit(F.col("digest"), hits.limit(0)))
    assert none.count() == 0
