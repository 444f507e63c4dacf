"""Mixing sources to target weights by iterative proportional fitting, in DataFrame expressions alone.

Token counts are summed over cells of source, language and topic. A cell keeps min(tokens, w) tokens in
expectation; raking scales the cells' w to each target marginal in turn, again and again, until the
*kept* tokens of all marginals hold together. So a cell that can't give more than it has is filled by
the others of its marginals, and what is sampled meets the targets, not only the weights. Each document
is kept with its cell's probability, by a number that depends on its id alone.

A budget may ask for more of a value than there is. Then it is lowered to what the scarcest value allows,
and further step by step until all targets are met at once; values that no step meets are named in a column.

Only values named in the targets have cells of their own, all others (and nulls) share one, so the
number of cells is bounded by the targets, whatever the number of sources; the bound is checked. The
fit runs over one row that holds the grid of all cells, and the cells' probabilities are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.session import materialize, written

#: Cells that a fit may have.
MOST_CELLS = 20_000
OTHER = "(other)"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Words to a hit above which a text isn't of a topic; budgets tried and their factor; how near a share must be, and
#: the part of the scarcest value that the first budget may need.
RARE, STEPS, SHRINK, NEAR, ROOM = 200, 12, 0.9, 0.0005, 0.97
# The beginnings of words, and the signs, that speak for a topic.
TOPICS = {
    "legal": "licen[cs]|lizen[zs]|licenci|copyright|urheber|derechos|droits|warrant|liabilit|haftung|gew[äa]hr|responsab|patent|redistribut|released under|terms of|all rights",
    "commerce": "subscri|abonn|suscri|discount|rabatt|descuento|promo|buy now|add to cart|warenkorb|panier|carrito|shipping|versand|free trial|special offer|click here",
}
REFERENCE, GENERAL = "[0-9]{3}|@", "general"


def _stems(stems: str) -> str:
    return f"(?i)(?:^|[^A-Za-z])(?:{stems})"


def topic_of(text: Column, tokens: Column) -> Column:
    """The topic whose signs occur most often in a text, with RARE words to a hit at most; ties go to the
    first in order, texts without enough signs, null and empty ones are general."""
    body = F.coalesce(text, F.lit(""))
    hits = [(name, F.regexp_count(body, F.lit(_stems(stems)))) for name, stems in TOPICS.items()]
    hits.append(("reference", F.regexp_count(body, F.lit(REFERENCE))))
    order = F.array(*[F.struct(n.alias("hits"), F.lit(-k).alias("by"), F.lit(name).alias("topic")) for k, (name, n) in enumerate(hits)])
    return _let(F.array_max(order), lambda best: F.when((best["hits"] > 0) & (best["hits"] * RARE >= tokens), best["topic"]).otherwise(GENERAL))


@dataclass(frozen=True)
class Targets:
    """Weights by value for each marginal; values that aren't named share one cell and keep their natural
    weight, and named values without any tokens leave theirs to the others. budget: the share of all
    tokens to keep, in expectation; less where the targets can't be met with so many. rounds: of
    raking. seed: of the documents' numbers."""

    source: dict[str, float] = field(default_factory=lambda: {f"src{i}": 1.0 for i in range(20)})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15})
    topic: dict[str, float] = field(default_factory=lambda: {"general": 0.94, "reference": 0.045, "legal": 0.01, "commerce": 0.005})
    budget: float = 0.7
    rounds: int = 100
    seed: int = 8

    def marginals(self) -> dict[str, dict[str, float]]:
        found = {"source": self.source, "lang": self.lang, "topic": self.topic}
        cells = prod(len(m) + 1 for m in found.values())
        if cells > MOST_CELLS:
            raise ValueError(f"the targets make {cells} cells; {MOST_CELLS} at most")
        if any(not w > 0 for m in found.values() for w in m.values()):
            raise ValueError("target weights must be positive")
        return found

    def budgets(self, top: float | None = None) -> list[float]:
        """The budgets that are tried, in turn, from the first one on; without it their factors."""
        return [(1.0 if top is None else top) * SHRINK**k for k in range(STEPS)]


def _index(value: Column, names: list[str]) -> Column:
    """1 and up for named values, 0 for all others."""
    if not names:
        return F.lit(0)
    known = F.create_map(*[F.lit(x) for pair in zip(names, range(1, len(names) + 1)) for x in pair])
    return F.coalesce(F.try_element_at(known, value), F.lit(0))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Grid:
    """SQL over arrays of the whole grid of cells, source-major: ``t`` has the tokens, ``w`` the weights."""

    def __init__(self, targets: Targets):
        self.targets, self.dims = targets, targets.marginals()
        self.sizes = {d: len(m) + 1 for d, m in self.dims.items()}
        self.cells = prod(self.sizes.values())
        names = list(self.sizes)
        self.inner = {d: prod(self.sizes[x] for x in names[k + 1 :]) for k, d in enumerate(names)}

    def place(self, dim: str, i: str, n: str) -> str:
        """The place of the n-th cell of a dimension's index i."""
        inner = self.inner[dim]
        return f"(CAST({n} DIV {inner} AS int) * {inner * self.sizes[dim]} + {i} * {inner} + {n} % {inner})"

    def index(self, dim: str, place: str) -> str:
        return f"(CAST({place} DIV {self.inner[dim]} AS int) % {self.sizes[dim]})"

    def sums(self, dim: str, value: str) -> str:
        """array<double>: for each index of a dimension the sum of ``value``, SQL over the place ``p``."""
        return f"""transform(sequence(0, {self.sizes[dim] - 1}), i -> aggregate(transform(sequence(0, {self.cells // self.sizes[dim] - 1}), n -> {self.place(dim, 'i', 'n')}),
          0D, (a, p) -> a + {value}))"""

    def goals(self, dim: str) -> str:
        """array<double>: the share of the kept tokens that each index should have; all sum to one."""
        wanted = ", ".join(["0D", *(f"{float(w)!r}D" for w in self.dims[dim].values())])
        return f"""transform(array({self.sums(dim, 'get(t, p)')}), own -> transform(array(aggregate(zip_with(own, array({wanted}), (o, g) -> if(o > 0, g, 0D)), 0D, (a, g) -> a + g)),
          live -> zip_with(own, transform(array({wanted}), (g, i) -> if(i = 0, -1D, g)), (o, g) -> CASE WHEN total <= 0 THEN 0D WHEN g < 0 THEN o / total
            WHEN o > 0 AND live > 0 THEN g / live * (total - get(own, 0)) / total ELSE 0D END))[0])[0]"""

    def rake(self, dim: str, w: str) -> str:
        """The weights after one scaling of a dimension. Of an index's kept tokens those of full cells are
        given, so the others are scaled to the rest; where no rest is left, all are scaled alike."""
        full, free = (self.sums(dim, f"if(get(w, p) {sign} get(t, p), get({what}, p), 0D)") for sign, what in ((">=", "t"), ("<", "w")))
        ratio = f"""zip_with(zip_with({full}, {free}, (c, f) -> struct(c, f)), goal_{dim}, (x, g) -> CASE WHEN x.c + x.f <= 0 THEN 0D
          WHEN x.f > 0 AND b * total * g > x.c THEN (b * total * g - x.c) / x.f ELSE b * total * g / (x.c + x.f) END)"""
        scaled = f"transform(w, (v, p) -> least(get(t, p) * 1e9D, v * get(ratio, {self.index(dim, 'p')})))"
        return f"transform(array({w}), w -> transform(array({ratio}), ratio -> {scaled})[0])[0]"

    def off(self, dim: str) -> str:
        """array<double>: how far each index's share of the kept tokens lies from its goal."""
        return f"zip_with({self.sums(dim, 'least(get(t, p), get(w, p))')}, goal_{dim}, (k, g) -> abs(k / kept - g))"

    def offs(self) -> str:
        kept = "aggregate(zip_with(t, w, (x, y) -> least(x, y)), 0D, (a, x) -> a + x)"
        return f"transform(array({kept}), kept -> if(kept > 0, concat({', '.join(self.off(d) for d in self.dims)}), array(0D)))[0]"

    def fitted(self) -> str:
        """struct<w, b, ok>: the weights of the first budget with which all shares come near their goals, else of the last."""
        once = "w"
        for d in self.dims:
            once = self.rake(d, once)
        raked = f"aggregate(sequence(1, {self.targets.rounds}), transform(t, x -> x * b), (w, r) -> {once})"
        ok = f"forall({self.offs()}, x -> x <= {NEAR}D)"
        tried = f"transform(array({raked}), w -> struct(w AS w, b AS b, {ok} AS ok))[0]"
        factors = ", ".join(f"{b!r}D" for b in self.targets.budgets())
        room = ", ".join(f"array_min(zip_with({self.sums(d, 'get(t, p)')}, goal_{d}, (n, g) -> if(g > 0, n / total / g, NULL)))" for d in self.dims)
        budgets = f"transform(array(least({self.targets.budget!r}D, {ROOM}D * least({room}))), top -> transform(array({factors}), f -> top * f))[0]"
        return f"""aggregate({budgets}, struct(CAST(NULL AS array<double>) AS w, 0D AS b, false AS ok), (best, b) -> if(best.ok, best, {tried}))"""

    def missed(self) -> str:
        """The names of the values whose shares stay off their goals, by comma."""
        names = [f"'{d}={v}'" for d, m in self.dims.items() for v in (OTHER, *(x.replace("'", "\\'") for x in m))]
        return f"array_join(filter(zip_with({self.offs()}, array({', '.join(names)}), (x, n) -> if(x > {2 * NEAR}D, n, NULL)), n -> n IS NOT NULL), ',')"


def cell_probabilities(cells: DataFrame, targets: Targets) -> DataFrame:
    """(source_no, lang_no, topic_no, weight, probability, budget, missed) from (source_no, lang_no, topic_no, tokens).

    weight is the cell's share of the kept tokens in expectation, budget the share of all tokens that is
    kept, missed the values whose share of the kept tokens lies more than 0.001 off its target. Cells
    without tokens cost nothing and are kept for certain."""
    grid = Grid(targets)
    at = F.col("source_no") * grid.inner["source"] + F.col("lang_no") * grid.inner["lang"] + F.col("topic_no")
    known = cells.select(at.cast("long").alias("id"), F.col("tokens").cast("double").alias("tokens"))
    whole = cells.sparkSession.range(grid.cells).join(known, "id", "left")
    one = whole.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("tokens", F.lit(0.0)).alias("tokens")))).alias("c"))
    one = one.selectExpr("transform(c, x -> x.tokens) AS t").selectExpr("t", "aggregate(t, 0D, (a, x) -> a + x) AS total")
    one = one.selectExpr("t", "total", *[f"{grid.goals(d)} AS goal_{d}" for d in grid.dims])
    one = one.selectExpr("*", f"{grid.fitted()} AS fit").selectExpr("*", "fit.w AS w", "fit.b AS b")
    one = one.selectExpr("t", "w", f"{grid.missed()} AS missed", "aggregate(zip_with(t, w, (x, y) -> least(x, y)), 0D, (a, x) -> a + x) AS kept", "total")
    one = materialize(one)  # one row; keeps the fit from being computed again for each column
    rows = one.selectExpr("posexplode(arrays_zip(t, w)) AS (p, c)", "kept", "total", "missed")
    share = F.when(F.col("c.t") > 0, F.least("c.t", "c.w"))
    return rows.select(
        *[F.expr(grid.index(d, "p")).alias(f"{d}_no") for d in grid.dims],
        F.round(F.coalesce(share / F.nullif("kept", F.lit(0.0)), F.lit(0.0)), 9).alias("weight"),
        F.round(F.coalesce(share / F.col("c.t"), F.lit(1.0)), 9).alias("probability"),
        F.round(F.coalesce(F.col("kept") / F.nullif("total", F.lit(0.0)), F.lit(1.0)), 9).alias("budget"),
        "missed",
    )


def draw_number(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from an id: 32 bits of an MD5 sum; a null id counts as the text ``null``."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def calibrated(df: DataFrame, targets: Targets = Targets(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and (mix_source, mix_lang, mix_topic, tokens, weight, probability, budget, missed, selected),
    a row for each row.

    Tokens are words between ASCII white space; a null text has none. Unnamed and null values show as
    ``(other)``. Null ids share one number. An empty table gives an empty table. The texts are read once:
    what the fit needs of them is written to the shared folder with the columns of ``keep``."""
    dims = targets.marginals()
    rows = df.select(
        *[df[c].alias(f"keep_{c}") for c in keep],
        F.coalesce(F.regexp_count(df["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
        draw_number(df["doc_id"], targets.seed).alias("number"),
        df["source"].alias("__source"), df["lang"].alias("__lang"), df["text"].alias("__text"),
    )
    values = {"source": F.col("__source"), "lang": F.col("__lang"), "topic": topic_of(F.col("__text"), F.col("tokens"))}
    rows = rows.select(
        *[f"keep_{c}" for c in keep], "tokens", "number", *[_index(values[d], list(w)).alias(f"{d}_no") for d, w in dims.items()]
    )
    rows = written(rows, "source-mix")
    keys = [f"{d}_no" for d in dims]
    cells = cell_probabilities(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), targets)
    joined = rows.join(F.broadcast(cells), keys, "left")
    names = [
        F.element_at(F.array(*[F.lit(x) for x in (OTHER, *w)]), F.col(f"{d}_no") + 1).alias(f"mix_{d}") for d, w in dims.items()
    ]
    return joined.select(
        *[F.col(f"keep_{c}").alias(c) for c in keep],
        *names,
        "tokens",
        "weight",
        "probability",
        "budget",
        "missed",
        (F.col("number") < F.col("probability")).alias("selected"),
    )


def sample_mix(df: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """The sampled rows of a table of documents, with the columns of documents."""
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    return calibrated(df, targets, columns).where("selected").select(*columns)


def oracle(targets: Targets = Targets()) -> str:
    """DuckDB SQL for calibrated() over documents: raking of all budgets in a recursive query."""
    dims = targets.marginals()

    def number(d, value):
        return "CASE " + " ".join(f"WHEN {value} = '{n}' THEN {i}" for i, n in enumerate(dims[d], 1)) + " ELSE 0 END"

    def named(d):
        return f"CASE {d}_no WHEN 0 THEN '{OTHER}' " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(dims[d], 1)) + " END"

    def goal(d):
        weights = " ".join(f"WHEN {i} THEN {float(w)!r}" for i, w in enumerate(dims[d].values(), 1))
        return f"""goal_{d} AS (
      SELECT k, n, sum(n) OVER () AS total, coalesce(CASE WHEN k = 0 THEN n / sum(n) OVER () ELSE w / nullif(sum(w) OVER (), 0) * (1 - sum(CASE WHEN k = 0 THEN n ELSE 0 END) OVER () / sum(n) OVER ()) END, 0) AS goal
      FROM (SELECT {d}_no AS k, sum(tokens)::DOUBLE AS n, CASE WHEN sum(tokens) > 0 THEN (CASE {d}_no {weights} ELSE 0 END)::DOUBLE ELSE 0 END AS w FROM cells GROUP BY 1))"""

    def rake(d, inner):
        return f"""SELECT * EXCLUDE (c, f, goal) REPLACE (least(t * 1e9, w * CASE WHEN c + f <= 0 THEN 0 WHEN f > 0 AND b * total * goal > c THEN (b * total * goal - c) / f
            ELSE b * total * goal / (c + f) END) AS w) FROM (
          SELECT r.*, g.goal, sum(CASE WHEN r.w >= r.t THEN r.t ELSE 0 END) OVER same AS c, sum(CASE WHEN r.w < r.t THEN r.w ELSE 0 END) OVER same AS f
          FROM ({inner}) r JOIN goal_{d} g ON g.k = r.{d}_no WINDOW same AS (PARTITION BY r.b, r.{d}_no))"""

    hits = [*((n, "regexp_extract_all(body, '" + _stems(s) + "')") for n, s in TOPICS.items()), ("reference", f"regexp_extract_all(body, '{REFERENCE}')")]
    topic = "CASE " + " ".join(
        f"WHEN n_{a} > 0 AND n_{a} * {RARE} >= tokens AND " + " AND ".join(f"n_{a} {'>' if j < i else '>='} n_{b}" for j, (b, _) in enumerate(hits) if j != i) + f" THEN '{a}'"
        for i, (a, _) in enumerate(hits)
    ) + f" ELSE '{GENERAL}' END"
    off = " UNION ALL ".join(
        f"SELECT b, {i} AS dim, '{d}=' || {named(d)} AS name, k, abs(coalesce(sum(least(t, w)) / nullif(any_value(kept), 0), any_value(goal)) - any_value(goal)) AS far FROM final JOIN goal_{d} ON k = {d}_no GROUP BY b, k, {d}_no"
        for i, d in enumerate(dims)
    )
    factors = ", ".join(f"{b!r}::DOUBLE" for b in targets.budgets())
    room = " UNION ALL ".join(f"SELECT min(n / total / goal) AS r FROM goal_{d} WHERE goal > 0" for d in dims)
    return f"""
    WITH RECURSIVE texts AS (
      SELECT doc_id, source, lang, coalesce(text, '') AS body, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
    counted AS (SELECT doc_id, source, lang, tokens, {', '.join(f'len({h}) AS n_{n}' for n, h in hits)} FROM texts),
    rows AS (
      SELECT doc_id, tokens, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '-{targets.seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS number,
        {number('source', 'source')} AS source_no, {number('lang', 'lang')} AS lang_no, {number('topic', f'({topic})')} AS topic_no
      FROM counted),
    cells AS (SELECT source_no, lang_no, topic_no, sum(tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL),
    {goal('source')}, {goal('lang')}, {goal('topic')},
    budgets AS (SELECT top * f AS b FROM (SELECT least({targets.budget!r}::DOUBLE, {ROOM} * min(r)) AS top FROM ({room})), (SELECT unnest([{factors}]) AS f)),
    raked AS (
      SELECT 0 AS round, b, source_no, lang_no, topic_no, tokens AS t, tokens * b AS w, (SELECT sum(tokens) FROM cells) AS total FROM cells, budgets
      UNION ALL
      SELECT round + 1, b, source_no, lang_no, topic_no, t, w, total FROM (
        {rake('topic', rake('lang', rake('source', 'SELECT * FROM raked')))}) WHERE round < {targets.rounds}),
    final AS (SELECT *, sum(least(t, w)) OVER (PARTITION BY b) AS kept FROM raked WHERE round = {targets.rounds}),
    offs AS ({off}),
    chosen AS (SELECT coalesce(max(b) FILTER (worst <= {NEAR}), min(b)) AS b FROM (SELECT b, max(far) AS worst FROM offs GROUP BY b)),
    named AS (SELECT coalesce(string_agg(name, ',' ORDER BY dim, k) FILTER (far > {2 * NEAR}), '') AS missed FROM offs JOIN chosen USING (b)),
    mixed AS (
      SELECT source_no, lang_no, topic_no, round(CASE WHEN t > 0 THEN coalesce(least(t, w) / nullif(kept, 0), 0) ELSE 0 END, 9) AS weight,
        round(CASE WHEN t > 0 THEN least(t, w) / t ELSE 1.0 END, 9) AS probability, round(coalesce(kept / nullif(total, 0), 1), 9) AS budget, missed
      FROM final JOIN chosen USING (b), named)
    SELECT doc_id, {named('source')} AS mix_source, {named('lang')} AS mix_lang, {named('topic')} AS mix_topic, tokens,
      weight::DOUBLE AS weight, probability::DOUBLE AS probability, budget::DOUBLE AS budget, missed, number < probability AS selected
    FROM rows JOIN mixed USING (source_no, lang_no, topic_no)"""
