"""The events of an agent's life, handled: what each step does to its payload, and whether it lets it pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.operators import egress, leaks
from veilspan.operators import vault as V
from veilspan.operators.detect import Detector, detect
from veilspan.session import written

COLUMNS = ("session", "seq", "event", "action", "verdict", "result", "note")


def handled(events: DataFrame, home: str, detector: Detector | None = None, prior: DataFrame | None = None, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(vault, outcomes) of events (session, seq, event, tool, payload).

    Outcomes are (session, seq, event, action, verdict, result, note), one row for each event:

    * ``scrub`` and ``rescan``: the payload with its values replaced by the session's placeholders; ``withheld``
      with the fixed notice where it is null. The note counts what was found.
    * ``check_path_and_restore``: ``blocked`` without a result where the call reads a denied path, which the
      note names; else the call's arguments with placeholders restored.
    * ``verify``: ``blocked`` without a result where a payload breaks an egress rule, which the note names.
    * ``check_echo``: ``flagged`` where a message repeats raw values of the vault; the note counts them.
    * all other steps let the payload pass as it is.

    The vault goes on from ``prior``; it is minted from all scrubbed and rescanned payloads before any is
    restored or checked, so a batch of events is handled in the steps' order, not by the clock. Repeated
    (session, seq) must not occur."""
    rows = events.select("session", "seq", "event", "tool", "payload").withColumn("action", egress.action_of(F.col("event")))
    rows = written(rows, "events")
    scrubs = rows.where(F.col("action").isin("scrub", "rescan"))
    found = written(detect(scrubs.withColumnRenamed("payload", "text"), "text", detector or Detector()), "hook-spans")
    vault = written(V.mint(V.found_values(found, "session", "seq"), prior), "hook-vault")
    clean = V.substitute(found, vault, "session", "seq").select("session", F.col("turn").alias("seq"), "scrubbed")
    safe = F.col("scrubbed").isNotNull()
    scrubbed = found.join(clean, ["session", "seq"]).select(
        "session", "seq", "event", "action", F.when(safe, "ok").otherwise("withheld").alias("verdict"), F.when(safe, F.col("scrubbed")).otherwise(egress.WITHHELD).alias("result"),
        F.when(safe, F.size("spans").cast("string")).alias("note"),
    )
    calls = rows.where("action = 'check_path_and_restore'").withColumn("path", egress.path_of_call(F.col("tool"), F.col("payload")))
    calls = calls.withColumn("denied", F.coalesce(egress.is_denied(F.col("path"), home, extra), F.lit(False)))
    back = V.rehydrate_bodies(calls.where("NOT denied").select("session", "seq", F.col("payload").alias("body")), vault, "session", "seq")
    called = calls.join(back.withColumnRenamed("turn", "seq"), ["session", "seq"], "left").select(
        "session", "seq", "event", "action", F.when(F.col("denied"), "blocked").otherwise("ok").alias("verdict"), F.when(~F.col("denied"), F.col("body")).alias("result"),
        F.when(F.col("denied"), F.col("path")).alias("note"),
    )
    sent = egress.verify(rows.where("action = 'verify'")).select(
        "session", "seq", "event", "action", F.when(F.col("safe"), "ok").otherwise("blocked").alias("verdict"), F.when(F.col("safe"), F.col("payload")).alias("result"),
        F.nullif(F.array_join("violations", ","), F.lit("")).alias("note"),
    )
    said = rows.where("action = 'check_echo'")
    echoes = leaks.raw_value_leaks(said.withColumnRenamed("seq", "turn"), vault).select("session", F.col("turn").alias("seq"), "n_leaks")
    said = said.join(echoes, ["session", "seq"], "left").select(
        "session", "seq", "event", "action", F.when(F.col("n_leaks") > 0, "flagged").otherwise("ok").alias("verdict"), F.col("payload").alias("result"), F.col("n_leaks").cast("string").alias("note")
    )
    rest = rows.where(~F.col("action").isin("scrub", "rescan", "check_path_and_restore", "verify", "check_echo"))
    rest = rest.select("session", "seq", "event", "action", F.lit("ok").alias("verdict"), F.col("payload").alias("result"), F.lit(None).cast("string").alias("note"))
    out = scrubbed
    for part in (called, sent, said, rest):
        out = out.unionByName(part)
    return vault, out.select(*COLUMNS)
