"""Personal data by patterns, checksums and context words, in DataFrame expressions alone.

For each kind a regular expression proposes spans: ``split`` gives the stretches between matches and
``regexp_extract_all`` the matches, in step, so that running lengths give code-point offsets. Luhn,
mod-97 and digit rules confirm or drop the proposals, and context words on either side move the
score. Each pattern is guarded by a cheap necessary condition, so a text without digits or at signs
costs little more than a scan. Quantifiers are possessive where no other match could follow from
giving back, which keeps long runs linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.spans import let, running_totals

#: Code points on each side of a span that are searched for context words.
CONTEXT_CHARS = 48


@dataclass(frozen=True)
class Kind:
    """pattern: proposes spans (Java regular expression). guard: necessary for a match, cheaper; a
    literal that the text must contain, or a pattern if it starts with a caret mark ``re:``. score: of
    a confirmed span. boost: added where a context word stands near, up to one. least: score to be kept."""

    name: str
    pattern: str
    guard: str
    context: str
    score: float
    boost: float = 0.35
    least: float = 0.0


# The patterns. In the e-mail pattern a match may only begin where a run of its signs
# begins or the match before it ended; that is where the leftmost match begins anyway.
LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|send|correo|courriel", 0.75),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"re:[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "host|server|addr|client|ip", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"re:[0-9](?:[\x20-]?[0-9]){13}", "card|credit|visa|master|amex|karte|tarjeta|carte", 0.6),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobil|cell|fax", 0.6),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])", r"re:[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", "iban|account|konto|compte|cuenta|bank", 0.7, least=0.6),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", r"re:[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|security", 0.35, least=0.6),
    Kind("phone_local", r"\([0-9]{3}\)\x20?[0-9]{3}[.\x20-][0-9]{4}(?![A-Za-z0-9_])", r"re:\([0-9]{3}\)", "phone|call|tel|mobil|cell|fax", 0.5, least=0.4),
)
BASE = ("email", "ip", "card", "phone")
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def mod97(code: Column) -> Column:
    """The remainder by 97 of an account number of letters and digits, its first four signs moved to the end."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, sign: F.when(sign == "", acc)
        .when(F.ascii(sign) >= 65, (acc * 100 + F.ascii(sign) - 55) % 97)
        .otherwise((acc * 10 + F.ascii(sign) - 48) % 97)
        .cast("int"),
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def confirmed(kind: str, value: Column) -> Column:
    """Whether a proposed value of a kind stands its checks."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit(""))) == 1
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$")
    return F.lit(True)


def _proposals(text: Column, kind: Kind) -> Column:
    """array<struct<kind, order, start, end, value, score>> of one kind's confirmed and kept spans."""
    order = [k.name for k in KINDS].index(kind.name)
    gaps = F.split(text, kind.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # the gap before and the gap after each match
    steps = F.zip_with(gaps, values, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    afters = F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0)))
    steps = F.zip_with(
        steps,
        afters,
        lambda s, after: F.struct(
            s["value"].alias("value"),
            F.length(s["gap"]).alias("skip"),
            F.concat_ws("\n", F.right(s["gap"], F.lit(CONTEXT_CHARS)), F.left(after, F.lit(CONTEXT_CHARS))).alias("near"),
        ),
    )
    steps = F.filter(steps, lambda s: s["value"].isNotNull())
    ends = lambda steps: running_totals(F.transform(steps, lambda s: (s["skip"] + F.length(s["value"])).cast("int")))
    place = lambda s, end: F.struct((end - F.length(s["value"])).alias("start"), end.alias("end"), s["value"].alias("value"), s["near"].alias("near"))
    spans = let(steps, lambda steps: F.zip_with(steps, ends(steps), place))
    spans = F.filter(spans, lambda s: confirmed(kind.name, s["value"]))
    spans = F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(order).alias("order"),
            s["end"].alias("end"),
            F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.round(F.lit(kind.score) + F.when(s["near"].rlike(f"(?i){kind.context}"), kind.boost).otherwise(0.0), 4)).alias("score"),
        ),
    )
    if kind.least:
        spans = F.filter(spans, lambda s: s["score"] >= kind.least)
    return spans


SPANS = "array<struct<start:int,order:int,end:int,kind:string,score:double>>"


def find_pii(df: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, order, end, kind, score>>): one row for each row, spans by
    start, then kind in the order of KINDS; offsets count code points and ends are exclusive.

    The base kinds stay whatever their score; other kinds are kept from their least score on. A null
    text counts as empty, texts are scanned whole, null ids stay null, repeated rows give repeated
    rows, an empty table gives an empty table, and other columns aren't read."""
    key = (df[id_col] if isinstance(id_col, str) else id_col).cast("long").alias("doc_id")
    text = F.coalesce(df[text_col] if isinstance(text_col, str) else text_col, F.lit("")).alias("text")
    docs = df.select(key, text)
    body = F.col("text")
    has_digits = body.rlike("[0-9]")
    docs = docs.select("doc_id", "text", has_digits.alias("digits"))
    columns = []
    for kind in KINDS:
        guard = body.rlike(kind.guard[3:]) if kind.guard.startswith("re:") else body.contains(kind.guard)
        if kind.name != "email":
            guard = F.col("digits") & guard
        columns.append(F.when(guard, _proposals(body, kind)).otherwise(F.array().cast(SPANS)).alias(kind.name))
    docs = docs.select("doc_id", *columns)
    return docs.select("doc_id", F.array_sort(F.concat(*[F.col(k.name) for k in KINDS])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def pii_digests(df: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text") -> DataFrame:
    """find_pii's spans as counts and digests, one row for each row; further columns: how many spans
    the method added, and the highest score."""
    found = find_pii(df, id_col, text_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_more"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def oracle() -> str:
    """DuckDB SQL for pii_digests() over documents, with the patterns in RE2's terms: word boundaries for
    the look-arounds, greedy quantifiers for the possessive ones."""
    plain = {
        "email": rf"[{LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "phone_local": r"\([0-9]{3}\)\x20?[0-9]{3}[.\x20-][0-9]{4}\b",
    }
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    weights = f"list_transform(list_reverse(string_split({digits}, '')), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)"
    code = "replace(value, ' ', '')"
    letters = f"list_transform(string_split(substr({code}, 5) || substr({code}, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN (ascii(c) - 55)::VARCHAR ELSE c END)"
    checks = {
        "ip": f"regexp_matches(value, '^{OCTET}(\\.{OCTET}){{3}}$')", "card": f"length({digits}) BETWEEN 14 AND 19 AND list_sum({weights}) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        # a remainder piece by piece, as the number may have seventy digits
        "iban": f"list_reduce(list_transform(string_split(array_to_string({letters}, ''), ''), lambda c: c::BIGINT), lambda a, c: (a * 10 + c) % 97) = 1",
        "ssn": "NOT regexp_matches(value, '^(?:000|666|9[0-9]{2})|-00-|-0000$')",
    }
    parts = []
    for order, k in enumerate(KINDS):
        p = "'" + plain[k.name] + "'"
        parts.append(f"""SELECT * FROM (SELECT doc_id, {order} AS ord, '{k.name}' AS kind, vals[n] AS value,
          (list_sum(list_transform(gaps[1:n], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:n - 1], lambda g: length(g))), 0))::INT AS s,
          least(1.0, round({k.score} + CASE WHEN regexp_matches(right(gaps[n], {CONTEXT_CHARS}) || chr(10) || left(gaps[n + 1], {CONTEXT_CHARS}), '(?i){k.context}') THEN {k.boost} ELSE 0 END, 4))::DOUBLE AS score
          FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS vals FROM documents WHERE regexp_matches(text, {p})) t, unnest(range(1, len(vals) + 1)) AS u(n))
          WHERE score >= {k.least} AND {checks.get(k.name, 'true')}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    label = "kind || ':' || s || ':' || (s + length(value))"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH found AS ({' UNION ALL '.join(parts)})
      SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({label}, ',' ORDER BY s, ord) FILTER (kind IN ({base})), '')) AS base_sha256,
        coalesce(string_agg({label}, ',' ORDER BY s, ord), '') AS spans, count(*) FILTER (kind NOT IN ({base})) AS n_more, coalesce(max(score), 0)::DOUBLE AS max_score
      FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id"""
