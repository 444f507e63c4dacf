"""Counts, audit events, recall, latency and session reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import written

TTL = 3600
GATES = {"secrets": 1.0, "pii": 0.95}


def metrics_by_type(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(type, n_spans, n_docs)."""
    return spans.groupBy("type").agg(F.count("*").alias("n_spans"), F.countDistinct(doc).alias("n_docs"))


def audit_events(spans: DataFrame, source: str) -> DataFrame:
    """(source, categories as JSON-like text, total_spans): one event for each source, categories by name."""
    counts = spans.groupBy(F.col(source).alias("source"), "type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("type", "n")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["type"], p["n"].cast("string"))), ",")
    return counts.groupBy("source").agg(text.alias("categories"), F.sum("n").alias("total_spans"))


def recall(items: DataFrame) -> DataFrame:
    """(category, grp, n, caught, recall, passed) from (category, item_no, grp, caught): a category's group is
    its first item's; a category without items has recall zero and can't appear without a row."""
    out = items.groupBy("category").agg(
        F.min_by("grp", "item_no").alias("grp"), F.count("caught").alias("n"), F.sum(F.col("caught").cast("int")).alias("caught")
    )
    out = out.withColumn("recall", F.coalesce(F.col("caught") / F.nullif("n", F.lit(0)), F.lit(0.0)))
    gate = F.create_map(*[F.lit(x) for pair in GATES.items() for x in pair])
    return out.withColumn("passed", F.col("recall") >= F.coalesce(F.try_element_at(gate, F.col("grp")), F.lit(1.0)))


def request_metrics(detected: DataFrame, spans: str = "spans") -> DataFrame:
    """(requests, withheld, total_spans, categories map<type, count>): one row over all detected texts."""
    total = detected.agg(F.count("*").alias("requests"), F.count(F.when(F.col(spans).isNull(), 1)).alias("withheld"), F.coalesce(F.sum(F.when(F.col(spans).isNotNull(), F.size(spans))), F.lit(0)).alias("total_spans"))
    each = detected.select(F.explode_outer(spans).alias("s")).where("s IS NOT NULL").groupBy("s.type").agg(F.count("*").alias("n"))
    table = each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("categories"))
    return total.join(table, F.lit(True))


def overall_recall(items: DataFrame) -> DataFrame:
    """(n, caught, recall, passed): one row over all items of (category, item_no, grp, caught); it passes if every
    category passes its gate, and without items recall is zero and nothing passes."""
    of = recall(items)
    out = of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("caught"), F.lit(0)).alias("caught"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))
    return out.select("n", "caught", F.coalesce(F.col("caught") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("recall"), "passed")


def rescan_hits(detected: DataFrame, by: str, spans: str = "spans") -> DataFrame:
    """(by, n_texts, n_hits, withheld): what a second scan of texts that were scrubbed still finds; texts whose scan failed are withheld."""
    hits = F.when(F.size(spans) > 0, F.size(spans)).otherwise(0)
    return detected.groupBy(by).agg(F.count("*").alias("n_texts"), F.sum(hits).cast("long").alias("n_hits"), F.count(F.when(F.col(spans).isNull(), 1)).alias("withheld"))


def unknown_chunks(chunks: DataFrame, clean: DataFrame, policy: str) -> DataFrame:
    """Chunks whose key isn't in the table of clean ones (key), which the same policy made: what must be scanned."""
    return chunks.withColumn("key", chunk_key(F.col("chunk"), policy)).join(clean.select("key"), "key", "left_anti")


def last_access(store: DataFrame, seen: DataFrame, now: str, ttl: int = TTL) -> DataFrame:
    """(session, at): a store of sessions with their last access brought up to date by newer ones; those whose
    last access lies more than ``ttl`` seconds before ``now`` are gone."""
    latest = store.select("session", "at").unionByName(seen.select("session", "at")).groupBy("session").agg(F.max("at").alias("at"))
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return latest.where(age <= ttl * 1_000_000)


def precision(spans: DataFrame, planted: DataFrame) -> DataFrame:
    """(type, n, hits, precision): spans that overlap a planted one of the same document."""
    marks = planted.select("doc_id", F.struct("start", "end").alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("ps"))
    hit = F.exists(F.coalesce("ps", F.array().cast("array<struct<start:int,end:int>>")), lambda p: (F.col("start") < p["end"]) & (F.col("end") > p["start"]))
    rows = spans.join(marks, "doc_id", "left").select("type", hit.cast("int").alias("hit"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("precision"))


def percentiles(samples: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, n, p array<double>): exact percentiles of each group, interpolated linearly, by selection instead of
    gathering: equal values are added up, dealt by ranges, and the counts of the ranges before tell each value's
    ranks; only the rows that hold a wanted rank go on. Null values don't count; a null group is a group."""
    same = samples.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    parts = written(same.repartitionByRange("by", "v").withColumn("part", F.spark_partition_id()), "percentiles")
    counts = parts.groupBy("by", "part").agg(F.sum("c").alias("held"))
    group = Window.partitionBy("by")
    before = F.coalesce(F.sum("held").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("by").alias("own"), F.col("part").alias("at"), before.alias("before"), F.sum("held").over(group).alias("n"))  # a row for each part of a group
    ends = F.sum("c").over(Window.partitionBy("by", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumn("end", ends).join(starts, F.col("by").eqNullSafe(F.col("own")) & (F.col("part") == F.col("at")))
    rows = rows.withColumn("end", F.col("end") + F.col("before")).withColumn("start", F.col("end") - F.col("c"))
    holds = lambda rank: (F.col("start") <= rank) & (rank < F.col("end"))
    spots = [share * (F.col("n") - 1) for share in shares]
    ends = [[F.max(F.when(holds(near(h)), F.col("v"))) for near in (F.floor, F.ceil)] for h in spots]
    found = rows.where(_any(holds(near(h)) for h in spots for near in (F.floor, F.ceil)))
    found = found.groupBy("by", "n").agg(*[x.alias(f"{side}{k}") for k, pair in enumerate(ends) for side, x in zip("lh", pair, strict=True)])
    lerp = [F.col(f"l{k}") + (F.col(f"h{k}") - F.col(f"l{k}")) * (h - F.floor(h)) for k, h in enumerate(spots)]
    return found.select(F.col("by").alias(by), "n", F.array(*lerp).alias("p"))


def _any(tests) -> Column:
    found = F.lit(False)
    for test in tests:
        found = found | test
    return found


def latency(samples: DataFrame, by: str, ms: str) -> DataFrame:
    """(by, p50, p95, p99, mean, max): exact percentiles, interpolated linearly. A group without a value has none of them."""
    p = percentiles(samples, by, ms, (0.5, 0.95, 0.99)).select(F.col(by).alias("own"), "p")
    out = samples.groupBy(by).agg(F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms")).join(p, F.col(by).eqNullSafe(F.col("own")), "left")
    return out.select(by, *[F.round(F.get("p", F.lit(i)), 4).alias(n) for i, n in enumerate(("p50", "p95", "p99"))], F.round("mean_ms", 4).alias("mean_ms"), "max_ms")


def sessions(events: DataFrame, user: str, ts: str, tie: str, ttl: int = TTL) -> DataFrame:
    """Adds session_no: a session ends when the last access lies more than ``ttl`` seconds back.

    Rows are dealt by ranges of user and time, so a user with most events lies in many tasks: each range looks
    back to the last access of the one before, and adds the sessions that began in those before it."""
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    ranged = written(events.repartitionByRange(user, ts, tie).withColumn("__part", F.spark_partition_id()), "sessions")
    parts, own = Window.partitionBy(user).orderBy("__part"), Window.partitionBy("__part", user).orderBy(ts, tie)
    edges = ranged.groupBy(user, "__part").agg(F.max(ts).alias("__last"))
    edges = edges.select(F.col(user).alias("__user"), F.col("__part").alias("__at"), F.lag("__last").over(parts).alias("__before"))
    here = F.col(user).eqNullSafe(F.col("__user")) & (F.col("__part") == F.col("__at"))
    rows = ranged.join(edges, here).drop("__user", "__at")
    gap = at(F.col(ts)) - at(F.coalesce(F.lag(ts).over(own), "__before"))
    rows = rows.withColumn("__new", F.when(gap > ttl * 1_000_000, 1).otherwise(0))
    begun = rows.groupBy(user, "__part").agg(F.sum("__new").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = begun.select(F.col(user).alias("__user"), F.col("__part").alias("__at"), earlier.alias("__earlier"))
    number = F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__earlier")
    return rows.join(begun, here).withColumn("session_no", number.cast("int")).select(*events.columns, "session_no")


def distinct_chunks(chunks: DataFrame, policy: str) -> DataFrame:
    """Chunks with the hash of the policy's fingerprint and their text; equal ones are kept once, which is
    what a cache of clean chunks is for."""
    keyed = chunks.withColumn("key", chunk_key(F.col("chunk"), policy))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def chunk_key(chunk: Column, policy: str) -> Column:
    return F.sha2(F.concat(F.lit(policy), chunk), 256)


def missed_samples(items: DataFrame, most: int = 5) -> DataFrame:
    """(category, missed): up to five missed items of each category in item order, 120 signs of the text and 60 of the value."""
    shown = F.concat_ws(" | ", F.left("text", F.lit(120)), F.left("value", F.lit(60)))
    # an outer explode keeps the filter above it: pushed below, it would scan each text once more for each use of the spans
    marked = items.select("category", "item_no", shown.alias("v"), F.explode_outer(F.array("caught")).alias("caught"))
    missed = marked.where(~F.col("caught")).drop("caught")
    first = Window.partitionBy("category").orderBy("item_no")
    few = missed.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)
    return few.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "v"))), lambda x: x["v"]).alias("missed"))
