"""Exact deduplication by a stateful stream.

A stream of fingerprints runs through a keyed state on disk that never expires: per digest
of the normalised text it keeps how many rows had it, and the stable id and content locator
of the row that stays.  The state is an aggregation in the RocksDB state store, so each
micro-batch combines the copies of a digest before the shuffle, and a new batch continues
where the last one ended.  A digest that was hit more than once is then checked on full
bytes: the smallest and largest text under it must be the same.  Digests that fail get
their groups from the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, staged
from .base import lower_ascii, small, text_of, unused

FILTER_BITS = 1 << 23       # 1 MB of bits that keep single texts out of the check
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # each open store sets 4 MB of disk aside; one batch is all that a run needs them for
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with its normalised text, and a locator: where the row's content lies, as
    file and row of the file."""
    norm, place = unused(docs.columns, "_norm"), unused(docs.columns, "_place")
    try:
        found = F.struct(F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.row_index").alias("row"))
        with_place = docs.select("*", found.alias(place))
        with_place.schema  # noqa: B018  fails here where the rows are not read from files
    except AnalysisException:
        docs = staged(docs)
        with_place = docs.select("*", F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row")).alias(place))
    return with_place.withColumn(norm, lower_ascii(text_of(text))), norm, place


def fold(spark: SparkSession, folder: str, schema, checkpoint: str,
         files_per_batch: int | None = None) -> DataFrame:
    """Run the stateful stream over the fingerprint files of a folder until it has read
    them all, and return the state: ``digest, entry, copies``.

    ``entry`` is the largest ``(id, locator)``.  The same ``checkpoint`` may be given again
    after files were added; the state then goes on from where it was.
    """
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        reader = spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        query = (reader.parquet(folder).groupBy("digest")
                 .agg(F.max("entry").alias("entry"), F.count(F.lit(1)).alias("copies"))
                 .writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        kept = {f.name: f.dataType for f in state.schema["value"].dataType}
        entry = next(f for f, kind in kept.items() if kind.typeName() == "struct")
        copies = next(f for f, kind in kept.items() if kind.typeName() == "long")
        return staged(state.select("key.digest", F.col(f"value.{entry}").alias("entry"),
                                   F.col(f"value.{copies}").alias("copies")))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def may_hit(digest: Column, hits: DataFrame) -> Column:
    """False for most digests that are not among ``hits``, never for one that is.

    A bitmap of fixed size, however many hits there are: digests that fall on no set bit
    stay out of the join, and their texts are not moved.  With more hits than bits it lets
    all pass, and the join decides alone.
    """
    def bit(d: Column) -> Column:
        return F.pmod(F.xxhash64(d), F.lit(FILTER_BITS)) + 1

    maps = hits.groupBy(F.bitmap_bucket_number(bit(F.col("digest"))).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit(F.col("digest")))).alias("bits"))
    every = maps.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits")))).scalar()
    found = F.try_element_at(every, F.bitmap_bucket_number(bit(digest)))
    at = F.bitmap_bit_position(bit(digest))
    byte = F.conv(F.hex(F.substring(found, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("int"), F.pmod(at, F.lit(8)).cast("int")) == 1,
                      F.lit(False))


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
           digest: Callable[[Column], Column] = digest,
           files_per_batch: int | None = None) -> DataFrame:
    """One row per document: ``key, place, digest, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z.  The row with the largest key
    stays; among rows with equal keys, and then a null key counts as the smallest, the one
    whose content lies last.  A null text is an empty one.  An empty table gives an empty
    result.  ``digest`` may be any function of the text, as equal digests are checked.
    """
    return _groups(*located(docs, text), key, digest, files_per_batch)


def _groups(rows: DataFrame, norm: str, place: str, key: str,
            digest: Callable[[Column], Column], files_per_batch: int | None) -> DataFrame:
    spark = rows.sparkSession
    prints = rows.select(F.col(key).alias("id"), F.col(place).alias("place"),
                         digest(F.col(norm)).alias("digest"))
    folder = new_folder(spark, "prints")
    prints.select("digest", F.struct("id", "place").alias("entry")).write.parquet(folder)
    prints = spark.read.parquet(folder)
    state = fold(spark, folder, prints.schema, new_folder(spark, "state"), files_per_batch)

    # full bytes on hits: copies of a digest within a task are one row of the shuffle
    hits = state.where("copies > 1").select("digest")
    texts = rows.select(digest(F.col(norm)).alias("digest"), F.col(norm).alias("norm"))
    texts = texts.where(may_hit(F.col("digest"), hits)).join(hits, "digest", "left_semi")
    ends = texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    mixed = small(ends.where("lo <> hi").select("digest"))
    if mixed.isEmpty():
        found = prints.join(state.select("digest", F.col("entry").alias("best"), "copies"),
                            "digest")
    else:
        calm = state.join(mixed, "digest", "left_anti")
        found = prints.join(calm.select("digest", F.col("entry").alias("best"), "copies"),
                            "digest")
        whole = rows.select(digest(F.col(norm)).alias("digest"), F.col(norm).alias("norm"),
                            F.struct(F.col(key).alias("id"), F.col(place).alias("place")
                                     ).alias("entry")).join(mixed, "digest")
        by_text = whole.groupBy("norm").agg(F.max("entry").alias("best"),
                                            F.count(F.lit(1)).alias("copies"))
        found = found.unionByName(whole.join(by_text, "norm").drop("norm"))
    return found.select(F.col("entry.id").alias(key), F.col("entry.place").alias("place"),
                        "digest", F.col("best.id").alias("keep_id"),
                        F.col("copies").alias("group_size"),
                        (F.col("entry.place") == F.col("best.place")).alias("kept"))


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its repeated texts, by the rules of :func:`groups`; further columns,
    whatever their names, are kept.  Rows are found again by their place, which is unique,
    so the copies of one text spread over all tasks."""
    rows, norm, place = located(docs, text)
    found = _groups(rows, norm, place, key, digest, None)
    gone = unused(rows.columns, "_gone")
    dropped = found.where(~F.col("kept")).select(F.col("place").alias(gone))
    return rows.join(dropped, F.col(place) == F.col(gone), "left_anti").select(*docs.columns)
