"""Session vaults: minting placeholders, substituting values, and restoring them.

A value has one placeholder per session, whatever its later types; numbers run per session and type in
the order of first sight. Order is always taken from the data (turn, then from right to left within a
text), never from the order in which tasks run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators import jsonwalk
from veilspan.operators.detect import Detector, detect
from veilspan.operators.rules import PLACEHOLDER
from veilspan.session import dropped, written


def found_values(detected: DataFrame, session: str, turn: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """(session, turn, start, end, type, value) for each span with a value that isn't empty."""
    valued = F.zip_with(spans, S.pieces(F.col(text), F.col(spans)), lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), v.alias("value")))
    rows = detected.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.explode_outer(valued).alias("s"))
    out = rows.select("session", "turn", "s.start", "s.end", "s.type", "s.value")
    return out.where("value <> ''")  # the outer explode keeps the spans from being computed twice, for a filter below


def mint(found: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(session, value, type, n, placeholder): the vault of each session.

    The last span of a text is minted first. ``prior`` is a vault to go on from: its values keep their
    placeholders and numbering continues after its greatest number per type."""
    first = first_sights(found)
    if prior is not None:
        first = first.join(prior.select("session", "value"), ["session", "value"], "left_anti")
    new = numbered(first, ("session", "type"), ("turn", "back", "value"))
    if prior is not None:
        last = prior.groupBy("session", "type").agg(F.max("n").alias("last"))
        new = new.join(last, ["session", "type"], "left").withColumn("n", F.col("n") + F.coalesce("last", F.lit(0)))
    new = new.select("session", "value", "type", F.col("n").cast("int").alias("n"))
    new = new.withColumn("placeholder", bracketed(F.col("type"), F.col("n")))
    return new if prior is None else prior.select(*new.columns).unionByName(new)


def first_sights(found: DataFrame) -> DataFrame:
    """(session, value, type, turn, back): where each value of a session was seen first."""
    first = found.groupBy("session", "value").agg(F.min(F.struct("turn", (-F.col("start")).alias("back"), "type")).alias("f"))
    return first.select("session", "value", "f.type", "f.turn", "f.back")


def numbered(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Adds n: the rows of each key numbered from 1 in an order that tells them apart.

    The rows are dealt by ranges of key and order, so a key with a third of all rows lies in many parts;
    each part numbers its own, and the parts before it add their counts."""
    ranged = rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "numbered")  # the ranges are drawn from a sample, so they must stay as they are
    own = ranged.withColumn("n", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return own.join(starts, [*keys, "__part"]).withColumn("n", F.col("n") + F.col("__before")).drop("__part", "__before")


def closed(vault: DataFrame, folder: str, key: bytes | None) -> str:
    """The end of a session: with a key the vault is sealed and written to the folder, or the folder is removed
    if the vault is empty; without one nothing is kept. Returns ``saved``, ``removed`` or ``dropped``."""
    if key is None:
        return "dropped"
    if vault.isEmpty():
        dropped(vault.sparkSession, folder)
        return "removed"
    sealed(vault, key).write.mode("overwrite").parquet(folder)
    return "saved"


def restored(spark: SparkSession, folder: str, key: bytes) -> DataFrame | None:
    """The vault that closed() saved; None where there is none or the key doesn't open it."""
    try:
        found = unsealed(spark.read.parquet(folder), key)
    except AnalysisException:
        return None
    return None if not found.where("value IS NULL").isEmpty() else found


def raw_values(vault: DataFrame) -> DataFrame:
    """(session, values): each session's raw values, in order."""
    return vault.groupBy("session").agg(F.array_sort(F.collect_set("value")).alias("values"))


def status(vault: DataFrame, healthy: bool) -> DataFrame:
    """(session, reachable, redacted, fail_closed): what the status command shows."""
    return vault.groupBy("session").agg(F.countDistinct("value").alias("redacted")).select("session", F.lit(healthy).alias("reachable"), "redacted", F.lit(True).alias("fail_closed"))


def show(vault: DataFrame) -> DataFrame:
    """(session, line): each placeholder and its type, never a value."""
    return vault.select("session", F.concat(F.col("placeholder"), F.lit(" -> ["), F.col("type"), F.lit("]")).alias("line"))


def shown_spans(detected: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """(keys, line): what the test command shows of each span of a text, or that there is none."""
    line = F.transform(spans, lambda s: F.format_string("[%d:%d] %s (%.2f, %s)", s["start"], s["end"], s["type"], s["score"], s["detector"]))
    return detected.select(*keys, F.explode(F.when(F.size(spans) > 0, line).otherwise(F.array(F.lit("no sensitive data")))).alias("line"))


def bracketed(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("[["), kind, F.lit("_"), n.cast("string"), F.lit("]]"))


# By type, the text before the number, the width to which zeros fill it, and the text after it.
SHAPES = {
    "EMAIL": ("user", 0, "@redacted.example"), "PHONE_NUMBER": ("555-000-", 4, ""), "CREDIT_CARD": ("4000-0000-0000-", 4, ""), "AWS_ACCESS_KEY": ("AKIA", 16, ""),
    "PERSON": ("Person_", 0, ""), "ORGANIZATION": ("Org_", 0, ""), "ADDRESS": ("", 0, " Redacted St, Anytown, XX 00000"), "URL": ("https://redacted.example/path/", 0, ""),
    "PRIVATE_KEY": ("[PRIVATE_KEY_", 0, "_REDACTED]"), "GENERIC_SECRET": ("REDACTED_SECRET_", 0, ""), "GITHUB_TOKEN": ("ghp_", 36, ""), "JWT": ("eyJ_REDACTED_", 0, ""),
    "STRIPE_KEY": ("sk_test_", 24, ""), "INTERNAL_HOSTNAME": ("host", 0, ".redacted.internal"), "PROJECT_CODENAME": ("Project_", 0, ""),
}


def format_preserving(kind: Column, n: Column) -> Column:
    """A fake of the value's own shape, numbered; types without a shape get brackets. Numbers longer than a
    width keep all their digits."""
    number = n.cast("string")
    out = F.when(kind == "IP_ADDRESS", F.concat_ws(".", F.lit("10.0"), (F.floor(n / 256) % 256).cast("string"), (n % 256).cast("string")))
    out = out.when(kind == "DB_CONNECTION_URL", F.concat(F.lit("postgres://user"), number, F.lit(":pass@redacted.example:5432/db"), number))
    for name, (before, width, after) in SHAPES.items():
        filled = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number) if width else number
        out = out.when(kind == name, F.concat(F.lit(before), filled, F.lit(after)))
    return out.otherwise(bracketed(kind, n))


def substitute(
    detected: DataFrame, vault: DataFrame, session: str, turn: str, text: str = "text", spans: str = "spans",
    write: Callable[[Column], Column] | None = None, helpers: tuple[str, ...] = (),
) -> DataFrame:
    """(session, turn, scrubbed): texts with their spans replaced by the session's placeholders. ``write`` puts the
    replacements (array<struct<start, end, with>>) in, by default into the text; ``helpers`` are columns it needs.

    Only the spans' values are shuffled to the vault; placeholders come back to their text as a map.
    A null text stays null, and so does a text whose spans are null: it fails closed."""
    found = found_values(detected, session, turn, text, spans).select("session", "turn", "value").distinct()
    own = found.join(vault.select("session", "value", "placeholder"), ["session", "value"])
    maps = own.groupBy("session", "turn").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "placeholder")))).alias("names"))
    rows = detected.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.col(text).alias("text"), F.col(spans).alias("spans"), *helpers)
    rows = rows.join(maps, ["session", "turn"], "left")
    body = F.col("text")

    named = lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(F.try_element_at(F.col("names"), v), v).alias("with"))
    filled = F.zip_with("spans", S.pieces(body, F.col("spans")), named)
    replaced = write(filled) if write else F.when(F.size("spans") > 0, S.splice(body, filled, lambda s: s["with"])).otherwise(body)
    return rows.select("session", "turn", F.when(F.col("spans").isNotNull(), replaced).alias("scrubbed"))


def scrub_until_clean(detected: DataFrame, session: str, turn: str, text: str = "text", spans: str = "spans", detector: Detector = Detector()) -> tuple[DataFrame, DataFrame]:
    """(vault, rows (session, turn, text, spans)): texts scrubbed, scanned again, and those in which something is still
    found scrubbed again by the same vault, until a scan finds nothing; ``spans`` is what a text's last scan found.

    A match that fails its check uses up the signs it ran over, such as a card number behind the last part of an
    address: once the address is replaced the number is found. Each round replaces signs that are no
    placeholder's, so there is an end. A text that wasn't scanned stays null: it fails closed.
    Keys are wrapped, so that null ones meet too."""
    rows = detected.select(F.struct(F.col(session).alias("key")).alias("session"), F.struct(F.col(turn).alias("key")).alias("turn"), F.col(text).alias("text"), F.col(spans).alias("spans"))
    vault, done = None, None
    while True:
        vault = written(mint(found_values(rows, "session", "turn"), vault), "vault")
        clean = substitute(rows, vault, "session", "turn").select("session", "turn", F.col("scrubbed").alias("text"))
        scanned = written(detect(clean, "text", detector), "scanned")
        rows = scanned.where(F.size("spans") > 0)
        own = scanned.where(F.coalesce(F.size("spans") <= 0, F.lit(True)))
        done = own if done is None else done.unionByName(own)
        if rows.isEmpty():
            keys = (F.col("session.key").alias("session"), F.col("turn.key").alias("turn"))
            return vault.withColumn("session", F.col("session.key")), done.select(*keys, "text", "spans")


def rehydrate(text: Column, names: Column) -> Column:
    """The text with each known placeholder replaced by its value; unknown ones stay. names: map."""
    gaps = F.split(text, PLACEHOLDER, -1)
    marks = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    values = F.transform(marks, lambda k: F.coalesce(F.try_element_at(names, k), k))
    return F.array_join(F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")


def scrub_bodies(bodies: DataFrame, session: str, turn: str, body: str = "body", detector=None, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vault, bodies): the strings of JSON bodies (session, turn, body) scrubbed by the session's vault, which
    goes on from ``prior``. Strings are seen in document order, and within one from right to left. Any body
    of any depth goes through: what isn't replaced stays as it is written."""
    texts = jsonwalk.body_texts(bodies, session, turn, body)
    found = written(detect(texts, "text", detector or Detector()), "bodies")
    vault = mint(found_values(found, "session", "turn"), prior)
    vault = written(vault, "vault")
    clean = substitute(found, vault, "session", "turn", write=jsonwalk.rewritten, helpers=IN_PLACE).select("session", "turn", F.col("scrubbed").alias("text"))
    return vault, jsonwalk.rebuilt(bodies, clean, session, turn, body)


#: Columns of body_texts() that tell how a text is written.
IN_PLACE = ("raw", "json", "at", "more")


def rehydrate_bodies(bodies: DataFrame, vault: DataFrame, session: str, turn: str, body: str = "body") -> DataFrame:
    """(session, turn, body): the strings of JSON bodies with their placeholders restored from the session's vault."""
    texts = jsonwalk.body_texts(bodies, session, turn, body)
    rows = texts.join(names_of(texts, vault), ["session", "turn"], "left").withColumn("marks", S.match_offsets("text", PLACEHOLDER))
    filled = F.transform(
        "marks", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.coalesce(F.try_element_at(F.col("names"), m["value"]), m["value"]).alias("with"))
    )
    return jsonwalk.rebuilt(bodies, rows.select("session", "turn", jsonwalk.rewritten(filled).alias("text")), session, turn, body)


def names_of(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """(session, turn, names map): for texts (session, turn, text) the values of the placeholders in them."""
    marks = texts.select("session", "turn", F.explode(F.array_distinct(placeholders(F.col("text")))["placeholder"]).alias("placeholder"))
    own = marks.join(vault.select("session", "placeholder", "value"), ["session", "placeholder"])
    return own.groupBy("session", "turn").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("names"))


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ /@-])", r"\\\1", text)


#: The signs that begin a fake or a placeholder, which are tested before all else.
_FIRST = "".join(sorted({"p", *"0123456789", *(before[0] for before, _, _ in SHAPES.values() if before and before[0] != "[")}))
#: Any fake or placeholder, with whatever digits follow: one pattern takes a text apart in one pass.
FAKE = rf"(?=[\[{_FIRST}])(?:" + "|".join((
    PLACEHOLDER, r"postgres://user[0-9]++:pass@redacted\.example:5432/db[0-9]++", r"10\.0\.[0-9]{1,3}+\.[0-9]++",
    *((_literal(before) if before else "(?<![0-9])") + "[0-9]++" + _literal(after) for before, _, after in SHAPES.values()),
)) + ")"


def rehydrate_formats(text: Column, names: Column) -> Column:
    """The text with each fake replaced by its value, in one pass: what has been put in isn't looked at again. Of the
    fakes that begin at a place the longest known one counts, so Org_11 isn't taken for Org_1. names: map."""
    gaps, marks = F.split(text, FAKE, -1), F.regexp_extract_all(text, F.lit(FAKE), F.lit(0))

    def value(mark):
        known = F.filter(F.sequence(F.length(mark), F.lit(1), F.lit(-1)), lambda n: F.map_contains_key(names, F.left(mark, n)))
        longest = F.when(F.map_contains_key(names, mark), F.length(mark)).otherwise(F.get(known, F.lit(0)))
        return S.let(longest, lambda n: F.when(n.isNull(), mark).otherwise(F.concat(F.try_element_at(names, F.left(mark, n)), F.substring(mark, n + 1, F.length(mark)))))

    whole = F.array_join(F.zip_with(gaps, F.transform(marks, value), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return F.when(F.size(names) == 0, text).otherwise(whole)  # without names every fake stays


def fakes_of(texts: DataFrame, vault: DataFrame) -> DataFrame:
    """(session, turn, names map): for texts (session, turn, text) the values of the fakes that may stand in them: each
    found fake, and for one that ends in digits those that end earlier."""
    marks = texts.select("session", "turn", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FAKE), F.lit(0)))).alias("mark"))
    digits = F.length("mark") - F.length(F.regexp_replace("mark", "[0-9]+$", ""))
    heads = F.transform(F.sequence(F.lit(0), F.greatest(digits - 1, F.lit(0))), lambda n: F.left("mark", F.length("mark") - n))
    each = marks.select("session", "turn", F.explode(heads).alias("placeholder")).distinct()
    own = each.join(vault.select("session", "placeholder", "value"), ["session", "placeholder"])
    return own.groupBy("session", "turn").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("names"))


def placeholders(text: Column) -> Column:
    """array<struct<placeholder, type, n>> in a text."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)),
        lambda p: F.struct(
            p.alias("placeholder"), F.regexp_extract(p, r"\[\[(.*)_[0-9]+\]\]", 1).alias("type"), F.regexp_extract(p, r"_([0-9]+)\]\]", 1).cast("int").alias("n")
        ),
    )


def reveal(vault: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session, placeholder, value) with ``(unknown)`` for placeholders that no vault has."""
    return wanted.join(vault.select("session", "placeholder", "value"), ["session", "placeholder"], "left").withColumn(
        "value", F.coalesce("value", F.lit("(unknown)"))
    )


def sealed(vault: DataFrame, key: bytes) -> DataFrame:
    """The vault with its values encrypted by AES-GCM under a key of 16, 24 or 32 bytes, for storage."""
    return vault.withColumn("value", F.base64(F.aes_encrypt(F.col("value").cast("binary"), F.lit(key), F.lit("GCM"))))


def unsealed(vault: DataFrame, key: bytes) -> DataFrame:
    """The vault back from sealed(); values that the key doesn't open are null, as a vault that can't be read."""
    return vault.withColumn("value", F.try_aes_decrypt(F.unbase64("value"), F.lit(key), F.lit("GCM")).cast("string"))


def derive_key(passphrase: str, salt: bytes, rounds: int = 100_000) -> bytes:
    """PBKDF2-SHA256 key of 32 bytes."""
    import hashlib

    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)
