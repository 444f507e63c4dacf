"""Spans of text as columns: extraction, filters, ordered merges and splicing, all of built-in expressions.

A span is struct<start, end, type, score, detector>; offsets count code points and ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,type:string,score:double,detector:string>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_sql(value: Column, name: str, body: str) -> Column:
    """The SQL ``body``, in which ``name`` is the value, computed once. Long bodies are parsed at once this way; built call by
    call they take longer than a scan of a small table."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, kind: str, score: float, detector: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("type"),
        F.lit(float(score)).alias("score"), F.lit(detector).alias("detector"),
    )


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Spans that a fold holds at hand before it sets them aside, which keeps long folds linear.
HELD = 64


def running_totals_sql(values: str) -> str:
    """SQL for the sums of an int array up to each place, by doubling: n log n, whatever the length."""
    steps = "sequence(0, CAST(greatest(0, ceil(log2(size(a))) - 1) AS int))"
    shifted = "slice(concat(array_repeat(0, shiftleft(1, k)), acc), 1, size(acc))"
    return f"transform(array({values}), a -> aggregate({steps}, a, (acc, k) -> zip_with(acc, {shifted}, (x, y) -> x + y)))[0]"


def running_totals(values: Column) -> Column:
    """As running_totals_sql, of a column."""

    def double(acc, k):
        gap = F.array_repeat(F.lit(0), F.call_function("shiftleft", F.lit(1), k))
        return F.zip_with(acc, F.slice(F.concat(gap, acc), F.lit(1), F.size(acc)), lambda x, y: x + y)

    steps = lambda a: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(a))) - 1).cast("int"))
    return let(values, lambda a: F.aggregate(steps(a), a, double))


def match_offsets_sql(text: str, pattern: str, group: int = 0) -> str:
    """SQL for array<struct<start, end, value>> of the leftmost non-overlapping matches in the SQL value ``text``.

    ``split`` gives the stretches between matches and ``regexp_extract_all`` the matches, in step; so no
    marks are put into the text and any text will do. A ``group`` must end where the match ends.
    As text, an expression of many rules is parsed at once instead of being built call by call."""
    p = quoted(pattern)
    whole = f"regexp_extract_all({text}, {p}, 0)"
    value = f"regexp_extract_all({text}, {p}, {group})" if group else whole
    return offsets_sql(f"split({text}, {p}, -1)", whole, value)


def offsets_sql(gaps: str, whole: str, value: str) -> str:
    """SQL for array<struct<start, end, value>> from the stretches between matches, the matches and their values."""
    steps = f"""filter(zip_with({gaps}, zip_with({whole}, {value}, (w, v) -> struct(length(w) AS long, v AS value)),
        (g, s) -> struct(length(g) + s.long AS long, s.value AS value)), s -> s.long IS NOT NULL)"""
    return f"""transform(array({steps}), steps -> zip_with(steps, {running_totals_sql('transform(steps, s -> s.long)')},
      (s, e) -> struct(e - length(s.value) AS start, e AS end, s.value AS value)))[0]"""


def match_offsets(text: str, pattern: str, group: int = 0) -> Column:
    return F.expr(match_offsets_sql(text, pattern, group))


def without_overlaps_sql(spans: str, safe: str) -> str:
    """SQL for the spans that overlap none of ``safe``, which are disjoint and in order: the interval anti join, within the row.

    Few safe stretches are tried one by one, many by bisection for the first that ends after the span's start."""
    meets = "s.start < z.end AND s.end > z.start"
    halve = f"""transform(array(CAST((e.low + e.high) DIV 2 AS int)), mid -> CASE WHEN get({safe}, mid).end > s.start
        THEN struct(e.low AS low, mid AS high) ELSE struct(mid + 1 AS low, e.high AS high) END)[0]"""
    first_after = f"""aggregate(sequence(1, CAST(ceil(log2(size({safe}) + 1)) AS int) + 1), struct(0 AS low, size({safe}) AS high),
        (e, k) -> CASE WHEN e.low < e.high THEN {halve} ELSE e END, e -> get({safe}, e.low))"""
    return f"""CASE WHEN size({safe}) > {HELD} THEN filter({spans}, s -> NOT coalesce(transform(array({first_after}), z -> {meets})[0], false))
      ELSE filter({spans}, s -> NOT exists({safe}, z -> {meets})) END"""


def without_overlaps(spans: Column, safe: Column) -> Column:
    """As without_overlaps_sql, of columns."""
    return let_sql(F.struct(spans.alias("spans"), safe.alias("safe")), "v", without_overlaps_sql("v.spans", "v.safe"))


def count_below(ordered: Column, value: Column) -> Column:
    """How many entries of an ordered int array are less than ``value``, by bisection."""

    def halve(ends, _):
        mid = F.call_function("div", ends["low"] + ends["high"], F.lit(2)).cast("int")
        low = F.get(ordered, mid) < value
        closer = F.struct(F.when(low, mid + 1).otherwise(ends["low"]).alias("low"), F.when(low, ends["high"]).otherwise(mid).alias("high"))
        return F.when(ends["low"] < ends["high"], closer).otherwise(ends)

    zero = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.size(ordered) + 1)).cast("int") + 1), zero, halve, lambda e: e["low"])


def without_values(spans: Column, text: Column, allowed: list[str]) -> Column:
    """Spans whose whole text isn't an allowed value; the comparison is exact."""
    if not allowed:
        return spans
    valued = F.zip_with(spans, pieces(text, spans), lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    return F.transform(F.filter(valued, lambda x: ~x["v"].isin(*allowed)), lambda x: x["s"])


def value_of(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def pieces(text: Column, ends: Column) -> Column:
    """array<string>: the stretches of a text (array<struct<start, end>>).

    A substring of UTF-8 is sought from the text's beginning, so many of them are taken from a form of four bytes for
    each sign, where a place is found at once."""
    few = lambda e: F.transform(e, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    wide = lambda w, e: F.transform(e, lambda s: F.decode(F.substring(w, s["start"] * 4 + 1, (s["end"] - s["start"]) * 4), "UTF-32"))
    return let(ends, lambda e: F.when(F.size(e) > HELD, let(F.encode(text, "UTF-32"), lambda w: wide(w, e))).otherwise(few(e)))


def _fold(spans: Column, keys: tuple[str, ...], extend: bool) -> Column:
    """The ordered fold of both merges; spans of which none begins before the one before it ends are only put in order.

    ``now`` has the spans at hand; all but the last of them are set aside in ``done`` when there are many."""
    last, head = "element_at(a, -1)", "slice(a, 1, size(a) - 1)"
    longer = f"struct({last}.start AS start, x.s.end AS end, {last}.type AS type, {last}.score AS score, {last}.detector AS detector)"
    kept = f"CASE WHEN x.s.end > {last}.end THEN concat({head}, array({longer})) ELSE a END" if extend else "a"
    wins = f"x.s.score > {last}.score OR (x.s.score = {last}.score AND x.s.end - x.s.start > {last}.end - {last}.start)"
    step = f"""CASE WHEN size(a) = 0 OR x.s.start >= coalesce({last}.end, 0) THEN concat(a, array(x.s))
        WHEN {wins} THEN concat({head}, array(x.s)) ELSE {kept} END"""
    many = f"size(acc.now) > {HELD}"
    held = f"""struct(CASE WHEN {many} THEN concat(acc.done, array(slice(acc.now, 1, size(acc.now) - 1))) ELSE acc.done END AS done,
        transform(array(CASE WHEN {many} THEN slice(acc.now, -1, 1) ELSE acc.now END), a -> {step})[0] AS now)"""
    folded = f"""aggregate(o, struct(CAST(array() AS array<{SPANS}>) AS done, CAST(array() AS {SPANS}) AS now), (acc, x) -> {held},
        acc -> concat(flatten(acc.done), acc.now))"""
    apart = "size(o) < 2 OR forall(zip_with(slice(o, 1, size(o) - 1), slice(o, 2, size(o) - 1), (a, b) -> b.s.start >= a.s.end), g -> g)"
    by = ", ".join(f"s.{k} AS by_{k}" for k in keys)
    ordered = f"array_sort(transform(spans, (s, i) -> struct({by}, i AS ord, s AS s)))"
    return let_sql(spans, "spans", f"transform(array({ordered}), o -> CASE WHEN {apart} THEN transform(o, x -> x.s) ELSE {folded} END)[0]")


def merge_extending(spans: Column) -> Column:
    """By start, stably: an overlapping span replaces the last if it scores higher, or equal and is wider;
    otherwise the last one's end grows to cover it. Adjacent spans stay apart."""
    return _fold(spans, ("start",), extend=True)


def merge_replacing(spans: Column) -> Column:
    """By start and end, stably: as merge_extending, but the loser is dropped and nothing grows. One span
    or none is returned as it is."""
    return _fold(spans, ("start", "end"), extend=False)


def add_only(spans: Column, more: Column) -> Column:
    """Adds spans that overlap none already there, and sorts by start; those there never change."""
    return F.array_sort(F.concat(spans, without_overlaps(more, spans)))


def splice(text: Column, spans: Column, replacement) -> Column:
    """The text with each of the disjoint, ordered spans replaced by replacement(span)."""
    def cut(ends):
        n = F.size(ends)
        starts = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.greatest(n - 1, F.lit(0))))
        gaps = F.zip_with(F.slice(starts, F.lit(1), n), spans, lambda at, s: F.struct(at.alias("start"), s["start"].alias("end")))
        rest = F.substring(text, F.coalesce(F.get(ends, n - 1), F.lit(0)) + 1, F.length(text))
        return F.concat(F.array_join(F.zip_with(pieces(text, gaps), spans, lambda g, s: F.concat(g, replacement(s))), ""), rest)

    return let(F.transform(spans, lambda s: s["end"]), cut)


def shannon_entropy(value: Column) -> Column:
    """Bits per character of a string's own character frequencies; an empty string has none."""
    n = F.length(value).cast("double")
    signs = F.filter(F.split(value, ""), lambda c: c != "")

    def term(c):
        p = F.size(F.filter(signs, lambda d: d == c)) / n
        return -p * F.log2(p)

    total = F.aggregate(F.transform(F.array_sort(F.array_distinct(signs)), term), F.lit(0.0), lambda a, x: a + x)
    return F.when(n > 0, total).otherwise(0.0)


def mod97(code: Column) -> Column:
    """ISO 13616 remainder: the first four signs go to the end, letters count 10 to 35."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def digit(acc, c):
        return (
            F.when(c == "", acc)
            .when(F.ascii(c) >= 65, (acc * 100 + F.ascii(c) - 55) % 97)
            .otherwise((acc * 10 + F.ascii(c) - 48) % 97)
            .cast("int")
        )

    return F.aggregate(F.split(F.upper(moved), ""), F.lit(0), digit)


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))
