"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from . import (byte_bpe, collocations, exact_dedup, minhash, mixing, pii, quality, secrets,
               sharding, simhash, spelling, token_counts, url_filter)
from .base import read, small, text_of

QUERIES = {}
ORACLES: dict[str, str] = {}


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(fn=None, *, sql: str | None = None):
    """Register a query, and the SQL for its rows where there is one."""
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return keep(fn) if fn else keep


@query
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes, by weights 5, 2, 1."""
    docs = mixing.word_counts(read(spark, folder, "documents")).select(
        "doc_id", "source", "size")
    docs = staged(docs)
    targets = small(mixing.target_sizes(mixing.repeating_weights(docs, (5, 2, 1))))
    mixed = mixing.mix(docs, targets)
    side = targets.select(F.col("source").alias("s"), "source_size", "target")
    return mixed.join(side, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "source")


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    return byte_bpe.digests(
        read(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.classes(read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every text, and whether it exceeds 2,048."""
    return token_counts.token_counts(
        read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(sql="""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts, and the document of each that stays."""
    found = exact_dedup.groups(read(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept",
                        F.col("digest").alias("text_sha256"))


@query(sql=rf"""
WITH d AS (SELECT *, row_number() OVER () AS k, coalesce(text, '') AS t, {WORDS} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
tri AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n
        FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM tri, (VALUES (0), (1), (2)) v(o)
        WHERE n > 1 GROUP BY k),
m AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines
      FROM d LEFT JOIN rep USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_words < 50 OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
             OR 5 * n_repeat_words > n_words OR word_chars < 3 * n_words
             OR word_chars > 12 * n_words AS soft FROM m),
h AS (SELECT source AS host, count(*) AS n, count(*) FILTER (soft) AS failed
      FROM f GROUP BY source),
-- beta-binomial moments: the variance of a rate over n_i documents is
-- mean (1 - mean) (1 + (n_i - 1) rho) / n_i, and alpha + beta = 1 / rho - 1
mu AS (SELECT sum(failed) / sum(n) AS mean, sum(n) AS docs FROM h),
v AS (SELECT mean, sum(n * pow(failed / n - mean, 2)) / docs / nullif(mean * (1 - mean), 0) AS s,
             count(*) / docs AS e FROM h, mu GROUP BY mean, docs),
q AS (SELECT mean, CASE WHEN (s - e) / nullif(1 - e, 0) > 1e-9
             THEN least(greatest(nullif(1 - e, 0) / (s - e) - 1, 1.0), 1000.0)
             ELSE 1000.0 END AS strength FROM v),
bad AS (SELECT host FROM h, q WHERE (failed + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (soft AND EXISTS (
           SELECT 1 FROM bad WHERE host IS NOT DISTINCT FROM source)) AS kept
FROM f""")
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality.report(read(spark, folder, "documents"), stage=staged)


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document, counts at most one apart."""
    text = text_of()
    docs = read(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"))
    return sharding.assign(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(read(spark, folder, "pages"), read(spark, folder, "labels"))


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every text."""
    return pii.digests(pii.find_pii(read(spark, folder, "documents")))


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text."""
    return secrets.digests(secrets.find_secrets(read(spark, folder, "documents"),
                                                stage=staged))


@query(sql=r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(
                 range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS f FROM s GROUP BY g),
-- of a set's shingles, rarest first, one of the first fifth (and one more) is in any set
-- at least 80 per cent alike
r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k
      FROM s JOIN f USING (g) JOIN n USING (doc_id)),
p AS (SELECT doc_id, g, n FROM r WHERE k <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b USING (g)
      WHERE a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
i AS (SELECT c.a, c.b, count(*) AS common FROM c JOIN s x ON x.doc_id = c.a
      JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS x, a AS y FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON e.a = y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id,
       coalesce(m, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)""")
def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Set size and near-duplicate class of every document."""
    return minhash.near_copies(read(spark, folder, "documents"))


@query(sql=r"""
WITH p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p
           FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                 FROM documents)),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
start AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS phrase, count(*) AS f
      FROM start, (VALUES (1), (2), (3)) v(s) WHERE i + s - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS q FROM g
      WHERE s > 1 AND f >= 10),
parts AS (SELECT c.*, k, array_to_string(q[1 : k], ' ') AS first,
                 array_to_string(q[k + 1 : s], ' ') AS rest
          FROM c, (VALUES (1), (2)) v(k) WHERE k < s),
often AS (SELECT lang, phrase, f FROM g WHERE f >= 10),
cut AS (SELECT parts.*, x.f AS l, y.f AS r,
               (1000000 * a::HUGEINT * a) // (x.f::HUGEINT * y.f) AS score
        FROM parts JOIN often x ON x.lang = parts.lang AND x.phrase = first
        JOIN often y ON y.lang = parts.lang AND y.phrase = rest),
best AS (SELECT * FROM cut
         QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
cover AS (SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, array_to_string(q[i : i + 1], ' ') AS phrase, a
            FROM c, (VALUES (1), (2)) v(i) WHERE s = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC,
                                encode(phrase)) AS rank,
       phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score
FROM best LEFT JOIN cover USING (lang, phrase) JOIN n USING (lang)
WHERE longer IS NULL OR 100 * longer < 50 * a
QUALIFY rank <= 2000""")
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return collocations.collocations(read(spark, folder, "documents"))


def crc_steps() -> str:
    """The 256 steps of CRC-32 as a list, from its rule."""
    def step(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c
    return "[" + ", ".join(str(step(k)) for k in range(256)) + "]"


@query(sql=rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, x, count(*) AS m FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[A-Za-zÀ-ÿ]+')) AS x FROM documents) GROUP BY ALL),
b AS (SELECT x, m, list_prepend(4294967295, list_transform(
             range(1, len(hex(encode(k)))::BIGINT, 2),
             lambda i: ('0x' || substr(hex(encode(k)), i, 2))::BIGINT)) AS bytes
      FROM (SELECT x, m, coalesce(doc_id::VARCHAR, '') || ':' || x AS k FROM r)),
h AS (SELECT x, m, xor(4294967295::BIGINT, list_reduce(bytes, lambda c, v: xor(
             ({crc_steps()})[xor(c, v) % 256 + 1], c >> 8))) AS h FROM b),
w AS (SELECT CASE WHEN h % 97 = 0 THEN x[1 : h % length(x)] || x[h % length(x) + 2 : length(x)]
                  ELSE x END AS word, m FROM h),
v AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM w WHERE length(word) >= 5
                   GROUP BY word HAVING sum(m) >= 3),
-- words less one character, and which
d AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 : length(word)] AS rest
                   FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b USING (rest, i)
      WHERE a.word <> b.word AND length(a.word) = length(b.word)
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON rest = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS form_n,
                arg_min(near, struct_pack(a := -m, b := encode(near))) AS form
         FROM p GROUP BY word),
f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN form_n >= 2 * v.n THEN form END AS form,
         CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f
         UNION SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at
         WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk USING (word) JOIN f e ON e.word = walk.at AND e.form IS NULL""")
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Words one edit apart, and the form and root of each."""
    return spelling.variants(read(spark, folder, "documents"))
