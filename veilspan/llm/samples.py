"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: log2 of the slots of a bitmap of ids, which is 8 MiB whatever the number of ids, and of those in one of its rows.
SLOTS, ROW_SLOTS = 26, 15


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null id is not held out (and has no label to learn from)."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def draw(rows: DataFrame, bound: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``bound`` rows of a table with doc_id, all where it has no more; the same ones each time."""
    total = rows.count() if total is None else total
    return rows if total <= bound else rows.where(uniform(F.col("doc_id"), seed) < bound / total)


def labelled(labels: DataFrame, label: str, value: int) -> DataFrame:
    """Ids of the learning folds that bear a label; null ids and null labels bear none."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].alias("label"))
    return ids.where((F.col("label") == value) & (remainder(F.col("doc_id")) != 0)).select("doc_id").distinct()


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among the doc_ids of ``ids``: all that are, and hardly others while ids are far fewer than slots.

    An exact join has to follow; what is left out here needn't be shuffled for it. The bitmap of the ids' hashes is put
    together by the executors and broadcast; its size is fixed. Null ids are left out."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << SLOTS))
    row, place = F.shiftright(slot, ROW_SLOTS).cast("int"), slot % (1 << ROW_SLOTS)
    filled = ids.where("doc_id IS NOT NULL").groupBy(row.alias("_row")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    eight = F.col("_bits").substr((F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    met = rows.where("doc_id IS NOT NULL").withColumn("_row", row).join(F.broadcast(filled), "_row")
    return met.where(F.getbit(F.conv(F.hex(eight), 16, 10).cast("int"), (place % 8).cast("int")) == 1).select(*rows.columns)
