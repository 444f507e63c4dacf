"""A cache of clean chunks that lives with a stream, so chunks that were scanned lately and held nothing are passed over.

Whether a chunk is clean is known after its scan only, so no state before the scan could learn it: each
micro-batch is tried against the cache that the batch before it left, what is unknown is scanned once for each
text, and the batch leaves its own cache. The cache has ``most`` entries at most, whatever the stream.
Chunks with findings are never in it, as their values must be found each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspan.operators.report import chunk_key
from veilspan.sources.events import recent
from veilspan.streaming.sinks import read_epochs, write_epoch

CACHE = "key string, at timestamp"


def tried(chunks: DataFrame, cache: DataFrame, policy: str, age: int = 300) -> DataFrame:
    """Adds (key, at, skipped): chunks (text, ts) whose text the cache has held for ``age`` seconds at most are skipped. Null
    texts have a null key and never are."""
    fresh = F.unix_micros("ts") - F.unix_micros("at") <= age * 1_000_000
    keyed = chunks.withColumn("key", chunk_key(F.col("text"), policy))
    return keyed.join(cache.select("key", "at"), "key", "left").withColumn("skipped", F.coalesce(fresh, F.lit(False)))


def to_scan(rows: DataFrame) -> DataFrame:
    """(key, text, at): each text of tried() that must be scanned, once, at its latest time. Equal texts are brought
    together before they are shuffled, so a text that holds a third of all rows is a few."""
    left = rows.where("NOT skipped AND key IS NOT NULL")
    return left.groupBy("key").agg(F.first("text").alias("text"), F.max("ts").alias("at"))


def brought_up(cache: DataFrame, rows: DataFrame, scanned: DataFrame, age: int, most: int, renew: bool) -> DataFrame:
    """(key, at): the cache after a batch: what was scanned and held nothing enters with its time, entries older than ``age``
    seconds at the latest time seen leave, then the oldest beyond ``most``. renew: whether a hit makes an entry young again."""
    marks = [cache.select("key", "at"), scanned.where(F.size("spans") == 0).select("key", "at")]
    if renew:
        marks.append(rows.where("skipped").groupBy("key").agg(F.max("ts").alias("at")))
    every = marks[0].unionByName(marks[1]) if not renew else marks[0].unionByName(marks[1]).unionByName(marks[2])
    now = rows.select(F.col("ts").alias("at")).unionByName(cache.select("at")).agg(F.max("at").cast("string")).first()[0]
    return recent(every, "key", "at", now, age, most) if now is not None else every.limit(0)


def scan_stream(
    chunks: DataFrame, scan: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, policy: str,
    age: int = 300, most: int = 256, renew: bool = False,
) -> StreamingQuery:
    """Scans a stream of chunks (text, ts and any columns not named key, at, skipped or spans) into a folder of epochs, which
    scanned_chunks() and cached() read.

    scan: adds ``spans`` to rows with the column text. policy: the fingerprint that keys depend on. A batch that runs
    again reads the cache of the batch before and replaces what it wrote, so it comes to the same result."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cache = _cache_of(spark, folder, epoch - 1)
        rows = tried(batch, cache, policy, age)
        write_epoch(scan(to_scan(rows)).select("key", "at", "spans"), f"{folder}/scanned", epoch)
        scanned = spark.read.parquet(f"{folder}/scanned/epoch={epoch}")
        write_epoch(brought_up(cache, rows, scanned, age, most, renew), f"{folder}/cache", epoch)
        dirty = scanned.where(F.size("spans") > 0).select("key", "spans")
        none = F.array().cast(scanned.schema["spans"].dataType)
        found = rows.drop("at").join(dirty, "key", "left").withColumn("spans", F.when(F.col("key").isNotNull(), F.coalesce("spans", none)))
        write_epoch(found.drop("text"), f"{folder}/chunks", epoch)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _cache_of(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    return read_epochs(spark, f"{folder}/cache", CACHE).where(F.col("epoch") == epoch).select("key", "at")


def scanned_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The stream's columns but the text, with key, skipped, spans (null for a null text) and epoch."""
    return spark.read.option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks")


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """(key, at): the cache that the last batch left."""
    last = scanned_chunks(spark, folder).agg(F.max("epoch")).first()[0]
    return _cache_of(spark, folder, last)
