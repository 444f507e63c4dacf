"""SQL text for DuckDB that says what the column expressions say, for checking them."""

from __future__ import annotations

from veilspan.operators.rules import PLACEHOLDER, Rule

OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def matches(source: str, key: str, text: str, pattern: str, group: int = 0) -> str:
    """(key, nth, s, e, value) of the leftmost non-overlapping matches in a column of a relation."""
    p = quoted(pattern)
    value = f"regexp_extract_all({text}, {p}, {group})"
    return f"""SELECT {key}, nth, e - length(value) AS s, e, value FROM (
      SELECT {key}, nth, vals[nth] AS value,
        coalesce(list_sum(list_transform(gaps[1:nth], lambda g: length(g))), 0)::INT + coalesce(list_sum(list_transform(whole[1:nth], lambda g: length(g))), 0)::INT AS e
      FROM (SELECT {key}, string_split_regex({text}, {p}) AS gaps, regexp_extract_all({text}, {p}) AS whole, {value} AS vals
        FROM {source} WHERE regexp_matches({text}, {p})) g, unnest(generate_series(1, len(whole))) AS u(nth))"""


def luhn(value: str) -> str:
    digits = f"list_reverse(list_transform(string_split(regexp_replace({value}, '[^0-9]', '', 'g'), ''), lambda c: c::INT))"
    return f"(list_sum(list_transform({digits}, lambda d, i: CASE WHEN i % 2 = 1 THEN d WHEN d > 4 THEN d * 2 - 9 ELSE d * 2 END)) % 10 = 0)"


def mod97(value: str) -> str:
    code = f"replace({value}, ' ', '')"
    moved = f"string_split(upper(substr({code}, 5) || substr({code}, 1, 4)), '')"
    step = "CASE WHEN ascii(c) >= 65 THEN (ascii(c) - 55)::VARCHAR ELSE c END"
    return f"(array_to_string(list_transform({moved}, lambda c: {step}), '')::HUGEINT % 97 = 1)"


def entropy(value: str) -> str:
    return f"list_aggregate(string_split({value}, ''), 'entropy')"


def check(rule: Rule, value: str = "value", least: float = 4.0) -> str:
    return {
        "luhn": luhn(value), "iban": mod97(value), "ip": f"regexp_matches({value}, '^{OCTET}(\\.{OCTET}){{3}}$')",
        "entropy": f"{entropy(value)} >= {least}", "": "true",
    }[rule.check]


def rule(source: str, key: str, text: str, r: Rule, ord: int = 0) -> str:
    """(key, ord, nth, s, e, value, type, score, detector) of one rule."""
    found = around(source, key, text, r.plain) if r.plain.startswith("(?:^") else matches(source, key, text, r.plain or r.pattern, 0 if r.plain else r.group)
    return f"""SELECT {key}, {ord} AS ord, nth, s, e, value, {quoted(r.entity)} AS type, {r.score}::DOUBLE AS score, {quoted(r.layer)} AS detector
      FROM ({found}) WHERE {check(r)}"""


def around(source: str, key: str, text: str, pattern: str) -> str:
    """As matches(), of group 1 of a pattern that takes one sign on either side, where there is one."""
    p = quoted(pattern)
    return f"""SELECT {key}, nth, e - length(value) - (whole[nth] <> value AND NOT ends_with(whole[nth], value))::INT AS s,
        e - (whole[nth] <> value AND NOT ends_with(whole[nth], value))::INT AS e, value FROM (
      SELECT {key}, nth, vals[nth] AS value, whole,
        coalesce(list_sum(list_transform(gaps[1:nth], lambda g: length(g))), 0)::INT + coalesce(list_sum(list_transform(whole[1:nth], lambda g: length(g))), 0)::INT AS e
      FROM (SELECT {key}, string_split_regex({text}, {p}) AS gaps, regexp_extract_all({text}, {p}) AS whole, regexp_extract_all({text}, {p}, 1) AS vals
        FROM {source} WHERE regexp_matches({text}, {p})) g, unnest(generate_series(1, len(whole))) AS u(nth))"""


def rules(source: str, key: str, text: str, which) -> str:
    return "\nUNION ALL\n".join(rule(source, key, text, r, i) for i, r in enumerate(which))


STRUCT = "{'s': s, 'e': e, 'type': type, 'score': score, 'detector': detector}"


def fold(items: str, extend: bool) -> str:
    """The ordered merge of a list of span structs that is sorted already; gives a list of structs."""
    last = "acc[-1]"
    wins = f"(x[1].score > {last}.score OR (x[1].score = {last}.score AND x[1].e - x[1].s > {last}.e - {last}.s))"
    longer = f"[{{'s': {last}.s, 'e': x[1].e, 'type': {last}.type, 'score': {last}.score, 'detector': {last}.detector}}]"
    grown = f"WHEN x[1].e > {last}.e THEN acc[:-2] || {longer}" if extend else ""
    step = f"CASE WHEN len(acc) = 0 OR x[1].s >= {last}.e THEN acc || x WHEN {wins} THEN acc[:-2] || x {grown} ELSE acc END"
    # the first span starts the fold, so that both sides of it have one type
    lists = f"list_transform({items}, lambda z: [z])"
    return f"(CASE WHEN len({items}) = 0 THEN [] ELSE list_reduce({lists}, lambda acc, x: {step}) END)"


def merged(found: str, key: str, extend: bool = True) -> str:
    """(key, s, e, type, score, detector) of the merged spans of a relation made by rules()."""
    order = "s, ord, nth" if extend else "s, e, ord, nth"
    lists = f"SELECT {key}, list({STRUCT} ORDER BY {order}) AS items FROM ({found}) GROUP BY {key}"
    return f"SELECT {key}, m.s AS s, m.e AS e, m.type AS type, m.score AS score, m.detector AS detector FROM (SELECT {key}, unnest({fold('items', extend)}) AS m FROM ({lists}))"


def newline_chunks(target: int) -> str:
    """(doc_id, no, off, chunk) of all documents."""
    return f"""chunks AS (
      SELECT doc_id, 0 AS no, 0 AS off, text, length(text) AS size, {cut('0', target)} AS width FROM documents WHERE length(text) > 0
      UNION ALL
      SELECT doc_id, no + 1, off + width, text, size, {cut('(off + width)', target)} FROM chunks WHERE off + width < size)"""


def cut(at: str, target: int) -> str:
    window = f"substr(text, {at}::INT + 1, {target + 1})"
    back = f"strpos(reverse({window}), chr(10))"
    return f"CASE WHEN {at} + {target} >= length(text) THEN length(text) - {at} WHEN {back} > 0 AND length({window}) - {back} > 0 THEN length({window}) - {back} + 1 ELSE {target} END::INT"


PLACEHOLDER_SQL = quoted(PLACEHOLDER)
