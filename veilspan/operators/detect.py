"""Detection: rules over a text column, suppression, merging, and the routing of long texts.

Everything is a column expression, so a scan is one stage without a shuffle. Each rule is guarded by
literals that any match must contain; guards never lose a match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import spans as S
from veilspan.operators.chunk import newline_chunks
from veilspan.operators.rules import DEFAULT_RULES, FAKES, PLACEHOLDER, PREFILTER, Rule

LONG_TEXT = 4096
FLOOR = 0.3
OCTETS = r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


@dataclass(frozen=True)
class Detector:
    """rules: in order; ties among equal spans go to the earlier rule. allow: exact values that are never
    reported. fakes: whether format-preserving fakes are exempt. entropy: bits from which a value counts."""

    rules: tuple[Rule, ...] = DEFAULT_RULES
    allow: tuple[str, ...] = ()
    fakes: bool = False
    entropy: float = 4.0
    floor: float = FLOOR

    def safe_sql(self, text_col: str) -> str:
        """SQL for the spans of placeholders, and of fakes where they are in use."""
        pattern = "(?:" + "|".join((PLACEHOLDER, *(FAKES if self.fakes else ()))) + ")"
        return S.match_offsets_sql(f"`{text_col}`", pattern)

    def safe(self, text_col: str) -> Column:
        return F.expr(self.safe_sql(text_col))


def confirmed_sql(check: str, value: str, entropy: float) -> str:
    """SQL for whether a proposed value stands its rule's check."""
    if check == "luhn":
        return f"luhn_check(regexp_replace({value}, '[^0-9]', ''))"
    if check == "iban":
        code = f"replace({value}, ' ', '')"
        return f"""aggregate(split(upper(concat(substring({code}, 5, 64), substring({code}, 1, 4))), ''), 0,
          (acc, c) -> CAST(CASE WHEN c = '' THEN acc WHEN ascii(c) >= 65 THEN (acc * 100 + ascii(c) - 55) % 97
            ELSE (acc * 10 + ascii(c) - 48) % 97 END AS int)) = 1"""
    if check == "ip":
        return f"{value} RLIKE {S.quoted(OCTETS)}"
    if check == "entropy":
        signs = f"filter(split({value}, ''), c -> c <> '')"
        share = f"(size(filter({signs}, d -> d = c)) / CAST(length({value}) AS double))"
        return f"""aggregate(transform(array_distinct({signs}), c -> -{share} * log2{share}), 0D, (a, x) -> a + x) >= {entropy}D"""
    return "true"


def sought(rule: Rule) -> str:
    """A rule's pattern with the signs that begin any match tested before all else."""
    if not rule.first:
        return rule.pattern
    flags, rest = re.match(r"(\(\?[a-z]+\))?(.*)", rule.pattern, re.DOTALL).groups()
    return f"{flags or ''}(?=[{rule.first}]){rest}"


def sign_column(signs: str) -> str:
    """The name of the column that says whether a text holds one of the signs."""
    return "__" + "_".join(f"{ord(c):x}" for c in signs)


def rule_sql(text: str, low: str, rule: Rule) -> str:
    """SQL for what one rule's pattern finds, before its check: struct<type, score, detector, check, gaps, whole, value> with
    the stretches between matches, the matches and the values of a group; null where a test rules it out. ``low`` is
    the text in lower case."""
    searched = text
    if rule.tail:  # no start is searched for an end that isn't there
        searched = f"left({text}, length({text}) - length(element_at(split({text}, {S.quoted(rule.tail)}, -1), -1)))"
    pattern = S.quoted(sought(rule))
    value = f"regexp_extract_all({searched}, {pattern}, {rule.group})" if rule.group else "CAST(NULL AS array<string>)"
    made = f"""struct({S.quoted(rule.entity)} AS type, {float(rule.score)}D AS score, {S.quoted(rule.layer)} AS detector, {S.quoted(rule.check)} AS check,
      split({searched}, {pattern}, -1) AS gaps, regexp_extract_all({searched}, {pattern}, 0) AS whole, {value} AS value)"""
    tests = [" OR ".join(f"contains({low if rule.fold else text}, {S.quoted(g)})" for g in rule.guard)] if rule.guard else []
    if rule.signs:
        tests.insert(0, sign_column(rule.signs))
    if rule.digits:
        tests.insert(0, "__digits")
    tests.append(f"{text} RLIKE {S.quoted(rule.tail) if rule.tail else pattern}")  # one search; offsets are only made where it holds
    return f"CASE WHEN {' AND '.join(f'({t})' for t in tests)} THEN {made} END"


def found_sql(rules: list[str], entropy: float) -> str:
    """SQL for the spans of all rules, from rule_sql() of each. Offsets and checks are written down once, for whichever
    rules found something: a plan's cost grows with its expressions, and most rules find nothing in most texts."""
    checks = " ".join(f"WHEN '{c}' THEN {confirmed_sql(c, 'm.value', entropy)}" for c in ("luhn", "iban", "ip", "entropy"))
    offsets = S.offsets_sql("r.gaps", "r.whole", "coalesce(r.value, r.whole)")
    sure = f"filter({offsets}, m -> CASE r.check WHEN '' THEN true {checks} END)"
    made = "struct(m.start AS start, m.end AS end, r.type AS type, r.score AS score, r.detector AS detector)"
    each = f"transform({sure}, m -> {made})"
    return f"flatten(transform(filter(array({', '.join(rules)}), r -> r IS NOT NULL), r -> {each}))"


def _others(df: DataFrame, out: str) -> list[Column]:
    """The columns of a frame but ``out``; each step over a scan is analysed with all its rules, so they are few."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != out]


def raw_spans(df: DataFrame, text_col: str, detector: Detector, out: str) -> DataFrame:
    """Adds the spans of all rules, in rule order; null for a null text."""
    name = f"`{text_col}`"
    if not detector.rules:
        return df.select(*_others(df, out), F.when(F.col(text_col).isNotNull(), S.no_spans()).alias(out))
    tests = {"__low": F.lower(F.col(text_col)), "__digits": F.col(text_col).rlike("[0-9]")}
    for signs in sorted({r.signs for r in detector.rules if r.signs}):
        tests[sign_column(signs)] = F.expr(" OR ".join(f"contains({name}, {S.quoted(c)})" for c in signs))
    helped = df.withColumns(tests)
    parts = found_sql([rule_sql(name, "__low", r) for r in detector.rules], detector.entropy)
    return helped.select(*_others(df, out), F.expr(f"CASE WHEN {name} IS NOT NULL THEN {parts} END").alias(out))


def suppressed(text_col: str, spans: str, detector: Detector) -> Column:
    """Spans (a column's name) above the floor, off the safe stretches, and not on the allow-list."""
    high = f"filter({spans}, s -> s.score >= {float(detector.floor)}D)"
    kept = F.expr(f"transform(array({detector.safe_sql(text_col)}), safe -> {S.without_overlaps_sql(high, 'safe')})[0]")
    return S.without_values(kept, F.col(text_col), list(detector.allow))


def detect(df: DataFrame, text_col: str = "text", detector: Detector = Detector(), out: str = "spans") -> DataFrame:
    """Adds the merged spans of each text; null texts have null spans, which fail closed downstream."""
    raw = raw_spans(df, text_col, detector, "__raw")
    kept = raw.withColumn("__raw", F.when(F.size("__raw") > 0, suppressed(text_col, "__raw", detector)).otherwise(F.col("__raw")))
    return kept.select(*_others(df, out), S.merge_extending(F.col("__raw")).alias(out))


def detect_routed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", detector: Detector = Detector(), lossy: bool = False
) -> DataFrame:
    """(id, spans): texts up to LONG_TEXT signs at once, longer ones by size.

    Cutting a text loses what lies across a cut, and all rules take time in proportion to the text, so
    long texts are scanned whole too: the result is that of detect(). ``lossy`` is the compatibility
    mode: long texts are cut into newline chunks, chunks that fail the cheap prefilter are passed over,
    equal chunks of one text are scanned once, and spans are re-based and merged; only multi-line key
    blocks are sought in the whole text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not lossy:
        return detect(rows, "text", detector).select(F.col("id").alias(id_col), "spans")
    short = detect(rows.where(F.length("text") <= LONG_TEXT), "text", detector).select("id", "spans")
    long = rows.where(F.length("text") > LONG_TEXT)
    blocks = tuple(r for r in detector.rules if r.tail)
    chunks = F.filter(newline_chunks(F.col("text")), lambda c: c["chunk"].rlike(PREFILTER))
    places = F.transform(
        F.array_distinct(F.transform(chunks, lambda c: c["chunk"])),
        lambda t: F.struct(t.alias("chunk"), F.transform(F.filter(chunks, lambda c: c["chunk"] == t), lambda c: c["offset"]).alias("offsets")),
    )
    each = long.select("id", F.explode(places).alias("c")).select("id", "c.chunk", "c.offsets")
    scanned = each_span(detect(each, "chunk", detector), "id", "offsets").select("id", F.explode("offsets").alias("offset"), "s")
    moved = F.struct((F.col("s.start") + F.col("offset")).alias("start"), (F.col("s.end") + F.col("offset")).alias("end"), "s.type", "s.score", "s.detector")
    scanned = scanned.select("id", moved.alias("s"))
    if blocks:
        whole = raw_spans(long, "text", Detector(rules=blocks), "spans")
        scanned = scanned.unionByName(each_span(whole, "id"))
    merged = scanned.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("spans")).select("id", S.merge_extending(F.col("spans")).alias("spans"))
    none = long.select("id").join(merged, "id", "left").select("id", F.coalesce("spans", S.no_spans()).alias("spans"))
    return short.unionByName(none).withColumnRenamed("id", id_col)


def exploded(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row for each span."""
    return each_span(df, *keys, spans=spans).select(*keys, "s.start", "s.end", "s.type", "s.score", "s.detector")


def each_span(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """(keys, s). An inner explode would let the optimiser test the spans' size in a filter below, and so
    compute them twice; an outer one followed by a filter computes them once."""
    return df.select(*keys, F.explode_outer(spans).alias("s")).where("s IS NOT NULL")
