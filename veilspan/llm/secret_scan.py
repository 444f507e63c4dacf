"""Secret scanning: fixed credential patterns, and a guess-cost dynamic programme over values that
stand in a credential context.

The dynamic programme segments a value into words, dates, repeats, keyboard walks and brute-force
spans so that the product of their guess counts is least. A value whose least cost reaches the
threshold could hardly be guessed, so it is taken for a secret.

Words are of two kinds: a short list of password words, and the letter pieces of a public tokenizer's
vocabulary, whose merge order ranks the words and syllables of many languages by how common they are.
So prose after a credential word ("the password is required") costs little and isn't a secret.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush
from math import log10

from pyspark.sql import Column, DataFrame

from veilspan.llm.arrow import map_columns

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# The contexts of the method, wider than the base patterns. A credential word begins where
# no letter stands before it, or at a capital after a small letter ("dbPassword"); group 1 is set in prose.
# A value may stand on the next line. In quotes it goes up to the same quote, else up to a blank or a separator.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"""
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth)"""
    r"""["']?(?:[\x20\t]*+(?:=>|:=|[:=])[\x20\t]*+(?:\r?\n[\x20\t]*+)?+|(\s++is\s++))"""
    r"""(?:"([^\s"]{6,}+)"|'([^\s']{6,}+)'|["']?([^\s"'<>,;]{6,}))""",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
#: Values that are nothing but a pointer to a secret: addresses without credentials, variables of templates and
#: shells, and calls. It must take the whole value, so a secret that holds such signs is none.
REFERENCE = re.compile(
    r"""(?i:https?)://[^@]*|\$\{[^{}]*\}?|\$\([\w./-]*\)?|\{\{[\w.|\[\]-]*\}{0,2}|\$(?:[A-Z_][A-Z0-9_]*|[a-z_][a-z0-9_]*)|%\(\w+\)s?|[A-Za-z_][\w.]*\(\)""",
    re.ASCII,
)

# Frequent words of passwords, most frequent first; a word's rank is its guess count.
WORDS = """password qwerty admin welcome login letmein dragon monkey master sunshine princess football baseball shadow
superman michael jordan hunter ranger soccer batman trustno hello freedom whatever secret summer winter spring autumn
january february march april june july august september october november december monday tuesday wednesday thursday
friday saturday sunday love money flower cookie pepper ginger maggie charlie thomas daniel andrew robert jennifer
jessica ashley nicole matthew joshua george harley killer computer internet server client system access default
changeme guest user test demo root oracle mysql postgres public private token key pass word the and for you your my
company office house hotel mother father brother sister baby angel star blue red green black white silver golden
orange purple happy lucky magic power tiger lion eagle cat dog horse bird fish""".split()
LEET = str.maketrans({"@": "a", "4": "a", "8": "b", "3": "e", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:\d{4}([-/._]?)\d{1,2}\1\d{1,2}|\d{1,2}([-/._]?)\d{1,2}\2(?:\d{4}|\d{2})|(?:19|20)\d\d)", re.ASCII)

SMALL_LETTERS = {a: a + 32 for a in range(65, 91)}
#: Letters of the longest word that is looked up, and of the longest unit of a repeat.
LONGEST, UNITS = 16, 4
#: log10 of guesses from which costs are no longer told apart; no key of 100 bits is told from a longer one.
CEILING = 30.0
#: Keys of a walk that costs the ceiling, at a factor of 0.35 for each.
LONGEST_WALK = 90
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def folded(text: str) -> str:
    """A-Z in lower case and nothing else, so that every sign keeps its place."""
    return text.translate(SMALL_LETTERS)


@lru_cache(maxsize=2)
def lexicon(vocabulary: str | None) -> dict[str, float]:
    """log10 of the rank of each known word.

    ``vocabulary`` is the path of a public tokenizer's rank file, or its name alone for an installed
    one; its pieces of three letters and more follow the password words in their order. None leaves
    the password words."""
    words = dict.fromkeys(WORDS)
    if vocabulary:
        if "/" not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        with open(vocabulary, "rb") as lines:
            pieces = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip() for line in lines if line.strip()]
        words.update(dict.fromkeys(folded(p) for p in pieces if p.isalpha() and 3 <= len(p) <= LONGEST))
    return {word: log10(rank) for rank, word in enumerate(words, 1)}


def _neighbours() -> set[tuple[str, str]]:
    """Pairs of keys that touch on a keyboard whose rows are shifted by half a key."""
    spots = {key: (x + y / 2, y) for y, row in enumerate(KEY_ROWS) for x, key in enumerate(row)}
    return {
        (a, b)
        for a, (ax, ay) in spots.items()
        for b, (bx, by) in spots.items()
        if a != b and abs(ay - by) <= 1 and abs(ax - bx) <= 1
    }


NEIGHBOURS = _neighbours()


def _brute(sign: str) -> float:
    if sign.isdigit():
        return 1.0
    if sign.isalpha():
        return log10(26)
    return log10(33)


def _alike(value: str, at: int, unit: int) -> int:
    """How many signs from ``at`` on equal the sign ``unit`` places later, by comparing growing stretches."""
    n, done, size = len(value) - unit - at, 0, 16
    while done < n:
        size = min(size, n - done)
        a, b = value[at + done : at + done + size], value[at + unit + done : at + unit + done + size]
        if a != b:
            while size > 1:
                half = size // 2
                if a[:half] == b[:half]:
                    done, a, b, size = done + half, a[half:], b[half:], size - half
                else:
                    a, b, size = a[:half], b[:half], half
            return done + (a == b)
        done, size = done + size, 2 * size
    return max(0, done)


class _Parts:
    """What can be guessed as one thing from a place of a value on. Runs are found once, from where they are first met."""

    def __init__(self, value: str, words: dict[str, float]):
        self.value, self.words, self.low = value, words, folded(value)
        self.plain = self.low.translate(LEET)
        self.walk_end = 0
        self.alike_end = [0] * (UNITS + 1)

    def walk(self, at: int) -> int:
        """Where the walk over touching keys ends; no further than a walk that costs the ceiling."""
        if at >= self.walk_end:
            low, end, most = self.low, at + 1, min(len(self.low), at + LONGEST_WALK)
            while end < most and (low[end - 1], low[end]) in NEIGHBOURS:
                end += 1
            if end == at + LONGEST_WALK:
                return at
            self.walk_end = end
        return self.walk_end

    def at(self, i: int) -> list[tuple[int, float]]:
        """(end, log10 of guesses) of the words, dates, walks and repeats that begin at i."""
        value, low, plain, n, found = self.value, self.low, self.plain, len(self.value), []
        for end in range(i + 3, min(n, i + LONGEST) + 1):
            for form in {low[i:end], plain[i:end]}:
                if form in self.words:
                    upper = sum(c.isupper() for c in value[i:end])
                    leet = sum(a != b for a, b in zip(low[i:end], form, strict=True))
                    extra = (0.3 if upper in (1, end - i) else 0.3 * upper) + 0.3 * leet
                    found.append((end, self.words[form] + extra))
        date = DATE.match(value, i)
        if date:
            found.append((date.end(), log10(365 * 120 if date.end() - i > 4 else 120)))
        length = self.walk(i) - i
        if length >= 4:
            found.append((i + length, log10(94) + 0.35 * length))
        for unit in range(1, UNITS + 1):
            if i + unit < n and value[i] == value[i + unit]:
                if i >= self.alike_end[unit]:
                    self.alike_end[unit] = i + _alike(value, i, unit)
                times = (self.alike_end[unit] - i) // unit + 1
                if times >= 2 and times * unit >= 4:
                    found.append((i + times * unit, sum(map(_brute, value[i : i + unit])) + log10(times)))
        return found


def guess_cost(value: str, vocabulary: str | None = VOCABULARY) -> float:
    """log10 of the guesses of the cheapest segmentation, CEILING at most; 0 for an empty value. See lexicon() for vocabulary.

    Every part after the first costs another factor of two, as the guesser must also find the cut. Places are
    taken in order, and a place is only looked at if its cost lies below the ceiling and below the best
    way to the end known so far. As each step costs something, few places of a long value are: a value of a
    million signs takes little longer than one of a hundred."""
    n, cut, far = len(value), log10(2), float("inf")
    if not n:
        return 0.0
    parts = _Parts(value, lexicon(vocabulary))
    brute, matched, bound = {}, {0: -cut}, CEILING
    places, known = [0], {0}
    while places:
        i = heappop(places)
        loose, tight = brute.pop(i, far), matched.pop(i, far)
        best = min(loose, tight)
        if i == n:
            return max(0.0, min(best, CEILING))
        if best >= bound:
            continue
        steps = [(brute, i + 1, min(loose, tight + cut) + _brute(value[i]))]
        steps += [(matched, end, best + cut + cost) for end, cost in parts.at(i)]
        for costs, end, cost in steps:
            if cost < bound and cost < costs.get(end, far):
                costs[end] = cost
                if end == n:
                    bound = cost
                if end not in known:
                    known.add(end)
                    heappush(places, end)
    return CEILING


#: Costs of short values, which repeat.
_cost_again = lru_cache(maxsize=1 << 14)(guess_cost)


@dataclass(frozen=True)
class SecretRules:
    """least: log10 of guesses from which an assigned value is a secret. prose: the same for values after
    "is", where words follow more often than secrets do. vocabulary: see lexicon()."""

    least: float = 9.0
    prose: float = 11.0
    vocabulary: str | None = VOCABULARY


def find_secrets(text: str, rules: SecretRules = SecretRules()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 of guesses) by start, then kind in the order assign, access, hex, guess.

    Offsets count code points and ends are exclusive. The first three kinds are the base patterns and
    span the whole match, their cost is 0; ``guess`` spans the value found by the method."""
    spans = []
    low = folded(text)
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            group = m.lastindex
            value = m[group].rstrip(".:!?)]}") if group == 4 else m[group]
            if len(value) < 6 or REFERENCE.fullmatch(m[group].rstrip(".:!?")):
                continue
            cost = (_cost_again if len(value) <= 64 else guess_cost)(value, rules.vocabulary)
            if cost >= (rules.prose if m[1] else rules.least):
                spans.append((m.start(group), 3, m.start(group) + len(value), cost))
    return [(KINDS[kind], start, end, cost) for start, kind, end, cost in sorted(spans)]


KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end, *_ in spans)


def redact(text: str, spans) -> str:
    """The text with each stretch covered by spans replaced by its first span's mark."""
    out, at = [], 0
    for kind, start, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[SECRET:{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(
    df: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", rules: SecretRules = SecretRules()
) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, log10_guesses>>, redacted): one row for each row.

    A null text counts as empty and has no spans; its redacted text stays null. Texts of any length
    and of any signs are scanned whole. The vocabulary is opened on the executors, so it must lie where
    every machine has it, as installed packages do. Null ids stay null, repeated rows give repeated rows, an empty table gives an
    empty table, and other columns aren't read."""
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int,log10_guesses:double>>, redacted string"

    def make():
        def apply(keys, texts):
            found = [find_secrets(t or "", rules) for t in texts]
            rows = [[dict(kind=k, start=s, end=e, log10_guesses=c) for k, s, e, c in x] for x in found]
            return keys, rows, [t if t is None else redact(t, x) for t, x in zip(texts, found, strict=True)]

        return apply

    return map_columns(df, _columns(df, id_col, text_col), schema, make)


def secret_digests(
    df: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", rules: SecretRules = SecretRules()
) -> DataFrame:
    """The operator's spans as counts and digests, one row for each row; see scan_secrets for odd rows."""
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "n_guess long, max_log10_guesses double"
    )

    def make():
        def apply(keys, texts):
            found = [find_secrets(t or "", rules) for t in texts]
            base = [[s for s in x if s[0] in BASE] for x in found]
            counts = [[sum(s[0] == kind for s in x) for x in found] for kind in KINDS]
            return (
                keys, counts[0], counts[1], counts[2],
                [hashlib.sha256(joined(x).encode()).hexdigest() for x in base],
                [joined(x) for x in found], counts[3],
                [max((s[3] for s in x), default=0.0) for x in found],
            )

        return apply

    return map_columns(df, _columns(df, id_col, text_col), schema, make)


def redact_secrets(df: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """A table of documents with the secrets in ``text`` replaced and ``n_chars`` brought up to date.

    Needs the columns of documents and returns exactly those; null texts stay null, with null n_chars."""
    schema = df.select("doc_id", "text", "lang", "source", "n_chars").schema

    def make():
        def apply(keys, texts, langs, sources):
            new = [t if t is None else redact(t, find_secrets(t, rules)) for t in texts]
            return keys, new, langs, sources, [t if t is None else len(t) for t in new]

        return apply

    return map_columns(df, [df["doc_id"], df["text"], df["lang"], df["source"]], schema, make)


def _columns(df: DataFrame, id_col: str | Column, text_col: str | Column) -> list[Column]:
    return [
        (df[id_col] if isinstance(id_col, str) else id_col).cast("long").alias("doc_id"),
        (df[text_col] if isinstance(text_col, str) else text_col).alias("text"),
    ]


__all__ = ["SecretRules", "find_secrets", "guess_cost", "redact_secrets", "scan_secrets", "secret_digests"]
