"""Raw values of a vault in what leaves: containment by an index of eight bytes.

Any value of eight signs has eight bytes or more, and UTF-8 holds a value wherever its bytes stand. So each
value is indexed under one run of eight bytes, the one that the fewest values of its session share; a
payload's own runs are looked up by an equi-join, and what meets is compared in full. Runs that no value
has are left out before the shuffle by a bitmap of fixed size, so what is shuffled grows with the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilspan.session import written

LEAK_LENGTH = 8
GRAM = 8
#: Runs of a value among which the rarest is chosen; any run of a value finds it.
RUNS = 64
#: log2 of the bitmap's slots: two MiB, whatever the vault's size.
SLOTS = 24
#: Bytes of texts that are looked at at once.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray) -> np.ndarray:
    """The runs of eight bytes that begin at each place, as numbers."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, GRAM)).view(np.uint64)[:, 0]


def slots(runs: np.ndarray) -> np.ndarray:
    return ((runs * _ODD) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of an Arrow array of strings or binaries, read where it lies; null counts as empty."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) else b"")
    _, offsets, held = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)), ends


def _arrow(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def index(vault: DataFrame) -> DataFrame:
    """(session, run, slot, offset, value): each value of eight signs or more under its rarest run of bytes."""
    values = vault.where(F.length("value") >= LEAK_LENGTH).select(F.col("session").cast("string").alias("session"), F.col("value").cast("binary").alias("value")).distinct()
    schema = "session string, run long, slot long, offset int, value binary"
    out = _arrow(schema)

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes_of(batch.column(1))
            for row in range(batch.num_rows):
                own = grams(data[ends[row] : min(ends[row + 1], ends[row] + RUNS + GRAM - 1)])
                _, first = np.unique(own, return_index=True)
                n = len(first)
                same = pa.array(np.full(n, row, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), pa.array(own[first].view(np.int64)), pa.array(slots(own[first])), pa.array(first.astype(np.int32)), batch.column(1).take(same)], schema=out
                )

    every = values.mapInArrow(runs_of, schema)
    shared = every.groupBy("session", "run").agg(F.count("*").alias("n"))
    rarest = F.min_by(F.struct("run", "slot", "offset"), F.struct("n", F.xxhash64("run")))
    return every.join(shared, ["session", "run"]).groupBy("session", "value").agg(rarest.alias("b")).select("session", "b.run", "b.slot", "b.offset", "value")


def bitmap(indexed: DataFrame) -> np.ndarray:
    """Which slots a run of the index has; the words of the bitmap are put together by the executors."""
    words = indexed.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits"))
    held = words.toArrow()  # 2 ** SLOTS / 64 rows at most
    bits = np.zeros(1 << (SLOTS - 6), np.uint64)
    bits[held.column("word").to_numpy()] = held.column("bits").to_numpy().view(np.uint64)
    return bits


def candidates(payloads: DataFrame, bits: np.ndarray) -> DataFrame:
    """(session, id, at, run): the places of payloads (session, id, payload) whose run of bytes may be in the index."""
    held = payloads.sparkSession.sparkContext.broadcast(bits)
    schema = "session string, id long, at long, run long"
    out = _arrow(schema)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = held.value
        for batch in batches:
            data, ends = _bytes_of(batch.column(2))
            for row in range(batch.num_rows):
                for start in range(ends[row], ends[row + 1] - GRAM + 1, PIECE):
                    own = grams(data[start : min(ends[row + 1], start + PIECE + GRAM - 1)])
                    slot = slots(own)
                    at = np.flatnonzero((filled[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
                    if len(at):
                        same = pa.array(np.full(len(at), row, np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(same), batch.column(1).take(same), pa.array(at + (start - ends[row])), pa.array(own[at].view(np.int64))], schema=out
                        )

    return payloads.select("session", "id", "payload").mapInArrow(places, schema)


def raw_value_leaks(payloads: DataFrame, vault: DataFrame, session: str = "session", payload: str = "payload") -> DataFrame:
    """(session, turn, n_leaks): how many of the session's values of eight signs or more a payload contains.

    Payloads and the index are written to the shared folder once; payloads with a candidate are joined to
    their candidates by row, so equal payloads and hot sessions lie in many tasks. Payloads without a
    leak have no row, a turn of several payloads counts for each; null payloads and null sessions hold
    nothing, repeated values count once. Long payloads are read in pieces of bounded size."""
    turn_type = payloads.schema["turn"].dataType.simpleString()
    rows = payloads.where(F.col(payload).isNotNull() & F.col(session).isNotNull())
    rows = rows.select(F.col(session).cast("string").alias("session"), "turn", F.col(payload).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("id"))
    rows = written(rows, "payloads")
    indexed = written(index(vault.where("session IS NOT NULL")), "leak-index")
    met = candidates(rows, bitmap(indexed)).join(indexed.drop("slot"), ["session", "run"])
    met = met.groupBy("id").agg(F.collect_list(F.struct((F.col("at") - F.col("offset")).alias("at"), "value")).alias("met"))
    schema = f"session string, turn {turn_type}, n long"
    out = _arrow(schema)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for text, found in zip(batch.column(2), batch.column(3), strict=True):
                body = text.as_buffer()
                seen = set()
                for one in found.as_py():
                    at, value = one["at"], one["value"]
                    if at >= 0 and value not in seen and body.slice(at, min(len(value), max(0, body.size - at))).to_pybytes() == value:
                        seen.add(value)
                counts.append(len(seen))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema=out)

    joined = rows.join(met, "id").select("session", "turn", "payload", "met").mapInArrow(verified, schema)
    sums = joined.where("n > 0").groupBy("session", "turn").agg(F.sum("n").alias("n_leaks"))
    return sums.withColumnRenamed("session", session)


def assistant_echoes(messages: DataFrame, vault: DataFrame, session: str = "session", text: str = "text") -> DataFrame:
    """(session, turn, n_leaks): messages of the assistant that repeat raw values of the session's vault; others aren't looked at."""
    return raw_value_leaks(messages.where(F.col("role") == "assistant"), vault, session, text)
