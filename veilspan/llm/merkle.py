"""A Merkle manifest of a dataset, by a block engine.

A leaf is the digest of a row. The rows of a key (a language) stand in a fixed order, and every ``fan``
consecutive nodes become one node, level by level, until one is left: the key's subroot. The subroots, by
key, make the root in the same way.

Positions are exact ranks, so they cut each key into aligned buckets of ``fan ** depth`` nodes, whose
levels don't depend on other buckets. Executors run a bucket's levels as DuckDB queries over its Arrow
table: an ordered string_agg and a sha256 for each level. The buckets' roots are the nodes of the next
round, with ``fan ** depth`` times fewer rows, so a few rounds do for any number of rows. On the way back
each bucket is joined to the proof of its own root, and the levels inside are put before it.
"""

from __future__ import annotations

from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.arrow import arrow_schema
from veilspan.session import written

FAN, DEPTH = 8, 4
#: Signs of a digest.
WIDE = 64
PATH = "array<struct<l:string,r:string>>"
NODE = "k string, pos long, n long, h string"
ROW = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# ---- leaves


def field(value: Column) -> Column:
    """A column of a row as hashed: ``-`` for null, else its bytes' number, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tampered(text: Column, doc_id: Column) -> Column:
    """What stands in for the text where 3 divides the id's crc32: the same with A-Z in lower case."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """(k, doc_id, h, t, tie): a row's key, its digest, that of its tampered form, and what tells repeated rows apart.

    A null language is a key of its own, before all others."""
    before = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), digest(*before, F.col("text")).alias("h"),
        digest(*before, tampered(F.col("text"), F.col("doc_id"))).alias("t"), F.monotonically_increasing_id().alias("tie"),
    )


# ---- positions


def placed(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows, which have a key k, with pos, their place within the key from 0 in the given order, and n, the key's rows.

    Rows are dealt by ranges of key and order, so a key with most rows lies in many parts; each part numbers
    its own on its way to the shared folder, and the parts before it add their counts."""
    ranged = rows.repartitionByRange("k", *order).sortWithinPartitions("k", *order)
    ranged = ranged.select(*rows.columns, F.spark_partition_id().alias("part"), F.lit(0).cast("long").alias("own"))
    schema = ranged.schema
    at_key, at_own = (schema.fieldNames().index(c) for c in ("k", "own"))

    def number(batches):
        last, n = None, 0
        for batch in batches:
            own = []
            for k in batch.column(at_key).to_pylist():
                last, n = (k, 0) if k != last else (k, n + 1)
                own.append(n)
            yield batch.set_column(at_own, batch.schema.field(at_own), pa.array(own, pa.int64()))

    numbered = written(ranged.mapInArrow(number, schema), "merkle-placed")
    counts = numbered.groupBy("k", "part").agg(F.count("*").alias("c"))
    every = Window.partitionBy("k")
    before = F.coalesce(F.sum("c").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("k", "part", before.alias("before"), F.sum("c").over(every).alias("n"))  # a row for each part of a key
    return numbered.join(starts, ["k", "part"]).select(*rows.columns, (F.col("own") + F.col("before")).alias("pos"), "n")


# ---- levels of a bucket


@lru_cache(maxsize=1)
def engine() -> duckdb.DuckDBPyConnection:
    """The worker's own in-memory database; buckets are small, so it never writes to disk."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def levels_of(n: int, fan: int, depth: int) -> int:
    """Levels until one of n nodes is left, ``depth`` at most."""
    count = 0
    while n > 1 and count < depth:
        n, count = -(-n // fan), count + 1
    return count


def levels_sql(levels: int, fan: int) -> str:
    """Common tables n1 to n<levels> (i, s, h): the runs of each level, their digests joined in order, and the run's digest."""
    steps = ["n0 AS (SELECT pos AS i, h FROM nodes)"]
    for level in range(1, levels + 1):
        runs = f"SELECT i // {fan} AS run, string_agg(h, '' ORDER BY i) AS s FROM n{level - 1} GROUP BY run"
        steps.append(f"n{level} AS MATERIALIZED (SELECT run AS i, s, sha256(s) AS h FROM ({runs}))")
    return "WITH " + ", ".join(steps)


def beside(level: int, fan: int) -> tuple[str, str]:
    """SQL for what stands left and right of a node's digest in its run of that level."""
    slot = f"({WIDE} * ((pos // {fan ** (level - 1)}) % {fan}))"
    return f"substr(n{level}.s, 1, {slot})", f"substr(n{level}.s, {slot} + {WIDE + 1})"


def _joins(levels: int, fan: int) -> str:
    return " ".join(f"JOIN n{level} ON n{level}.i = pos // {fan**level}" for level in range(1, levels + 1))


def _queried(sql: str, nodes: pa.Table, schema: pa.Schema, values: dict | None = None) -> pa.Table:
    con = engine()
    con.register("nodes", nodes)
    try:
        return con.sql(sql, params=values or {}).to_arrow_table().select(schema.names).cast(schema)
    finally:
        con.unregister("nodes")


def bucket_roots(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """One node for each bucket of (k, pos, n, h): the nodes of the next round."""
    schema, wide = arrow_schema(NODE), fan**depth

    def root(key, bucket):
        n = bucket.column("n")[0].as_py()
        levels = levels_of(n, fan, depth)
        sql = f"{levels_sql(levels, fan)} SELECT $k AS k, $bucket::BIGINT AS pos, $n::BIGINT AS n, h FROM n{levels}"
        return _queried(sql, bucket, schema, {"k": key[0].as_py(), "bucket": key[1].as_py(), "n": -(-n // wide)})

    rows = nodes.select("k", (F.expr(f"pos div {wide}")).alias("bucket"), "pos", "n", "h")
    return rows.groupBy("k", "bucket").applyInArrow(root, NODE)


def rounds(nodes: DataFrame, fan: int, depth: int) -> list[DataFrame]:
    """The nodes of each round, written; those of the last are the keys' roots, one each."""
    out = [nodes]
    while True:
        out.append(written(bucket_roots(out[-1], fan, depth), "merkle-round"))
        if (out[-1].agg(F.max("n")).first()[0] or 1) <= 1:
            return out


def paths(nodes: DataFrame, above: DataFrame, fan: int, depth: int) -> DataFrame:
    """(k, pos, name, path, subroot, root) of nodes (k, pos, n, h, name) from those of the buckets' roots: what
    stands left and right of a node on each level up to the root."""
    schema = arrow_schema(out := f"k string, pos long, name string, h string, path {PATH}, subroot string, root string")

    def path(key, bucket, of):
        levels = levels_of(bucket.column("n")[0].as_py(), fan, depth)
        own = ", ".join("{{'l': {}, 'r': {}}}".format(*beside(level, fan)) for level in range(1, levels + 1))
        up = of.to_pylist()[0]
        lists = f"list_concat([{own}]::STRUCT(l VARCHAR, r VARCHAR)[], $up::STRUCT(l VARCHAR, r VARCHAR)[])"
        sql = f"""{levels_sql(levels, fan)} SELECT $k AS k, pos, name, nodes.h, {lists} AS path, $subroot::VARCHAR AS subroot, $root::VARCHAR AS root
          FROM nodes {_joins(levels, fan)}"""
        return _queried(sql, bucket, schema, {"k": key[0].as_py(), "up": up["path"], "subroot": up["subroot"], "root": up["root"]})

    return _by_bucket(nodes.select("k", "pos", "n", "h", "name"), above, fan, depth, path, out)


def _by_bucket(nodes: DataFrame, above: DataFrame, fan: int, depth: int, function, schema: str) -> DataFrame:
    rows = nodes.withColumn("bucket", F.expr(f"pos div {fan**depth}")).groupBy("k", "bucket")
    up = above.select("k", F.col("pos").alias("bucket"), "path", "subroot", "root").groupBy("k", "bucket")
    return rows.cogroup(up).applyInArrow(function, schema)


def proofs(nodes: DataFrame, above: DataFrame, fan: int, depth: int) -> DataFrame:
    """The manifest's rows, of the leaves and of the paths of their buckets' roots."""
    schema = arrow_schema(ROW)

    def prove(key, bucket, of):
        levels = levels_of(bucket.column("n")[0].as_py(), fan, depth)
        up = of.to_pylist()[0]
        sides = [beside(level, fan) for level in range(1, levels + 1)] + [(f"$l{i}", f"$r{i}") for i in range(len(up["path"]))]
        folded = "t"
        for left, right in sides:
            folded = f"sha256({left} || {folded} || {right})"
        siblings = " || ".join(["''", *(s for pair in sides for s in pair)])
        sql = f"""{levels_sql(levels, fan)} SELECT *, folded_root = root AS verified FROM (SELECT doc_id, nodes.h AS leaf, $subroot::VARCHAR AS subroot,
          $root::VARCHAR AS root, sha256({siblings}) AS proof_sha256, {folded} AS folded_root FROM nodes {_joins(levels, fan)})"""
        values = {f"{side}{i}": step[side] for i, step in enumerate(up["path"]) for side in "lr"}
        return _queried(sql, bucket, schema, values | {"subroot": up["subroot"], "root": up["root"]})

    return _by_bucket(nodes.select("k", "pos", "n", "h", "t", "doc_id"), above, fan, depth, prove, ROW)


# ---- the manifest


def manifest(docs: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row for each row of documents.

    ``proof_sha256`` is the digest of all siblings from the leaf's level to the root's. ``folded_root`` is
    what the leaf of the tampered row, else the row's own, folds to with these siblings; ``verified`` says
    whether that is the root. Nulls of any column are hashed as ``-``; a null id comes first in its key; rows
    that repeat an id stand by digest, and rows that are equal throughout give one row each; an empty table
    gives none. Columns other than those of documents aren't read. Texts are hashed once, where they are
    read; digests alone are shuffled and written to the shared folder."""
    rows = placed(written(leaves(docs), "merkle-leaves"), ("doc_id", "h", "tie"))
    own = rounds(rows, fan, depth)
    keys = own[-1].select(F.lit("").alias("k"), F.col("k").alias("name"), "h")
    top = rounds(placed(keys, ("name",)), fan, depth)
    nowhere = F.array().cast(PATH)
    above = top[-1].select("k", "pos", nowhere.alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    for nodes in reversed(top[:-1]):
        above = paths(_named(nodes), above, fan, depth)
    above = above.select(F.col("name").alias("k"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot"), "root")
    for nodes in reversed(own[1:-1]):
        above = paths(_named(nodes), above, fan, depth)
    return proofs(rows, above, fan, depth)


def _named(nodes: DataFrame) -> DataFrame:
    return nodes if "name" in nodes.columns else nodes.withColumn("name", F.lit(""))


def oracle(fan: int = FAN) -> str:
    """The manifest in SQL, level by level; crc32 is written out, as DuckDB has none."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END"
    byte = f"list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {bit})"
    crc = f"""xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b: {byte}), 4294967295::BIGINT)"""
    climb = f"""SELECT l.k, l.level + 1, l.pos // {fan}, max(l.n + {fan - 1}) // {fan}, sha256(string_agg(l.h, '' ORDER BY l.pos)), string_agg(l.h, '' ORDER BY l.pos)
      FROM {{0}} l WHERE l.n > 1 GROUP BY l.k, l.level, l.pos // {fan}"""
    sides = """SELECT t.id, string_agg(substr(r.s, 1, (64 * ((t.pos // power({fan}, r.level - 1)::BIGINT) % {fan}))::INT) || substr(r.s, (64 * ((t.pos // power({fan}, r.level - 1)::BIGINT) % {fan}) + 65)::INT), '' ORDER BY r.level) AS p,
      list({{'l': substr(r.s, 1, (64 * ((t.pos // power({fan}, r.level - 1)::BIGINT) % {fan}))::INT), 'r': substr(r.s, (64 * ((t.pos // power({fan}, r.level - 1)::BIGINT) % {fan}) + 65)::INT)}} ORDER BY r.level) AS steps
      FROM {t} t JOIN {r} r ON r.k = t.k AND r.level > 0 AND r.pos = t.pos // power({fan}, r.level)::BIGINT GROUP BY t.id"""
    fold = "list_reduce([{{'l': '', 'r': {0}}}] || coalesce({1}, []::STRUCT(l VARCHAR, r VARCHAR)[]), lambda a, b: {{'l': '', 'r': sha256(b.l || a.r || b.r)}}).r"
    return f"""WITH RECURSIVE digests AS (SELECT doc_id, coalesce('=' || lang, '') AS k, sha256({head} || {part('text')}) AS h,
        CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {part(low)}) END AS changed FROM documents),
      leaf AS MATERIALIZED (SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM digests),
      tree(k, level, pos, n, h, s) AS (SELECT k, 0, pos, n, h, '' FROM leaf UNION ALL {climb.format('tree')}),
      sub AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k) AS id, '' AS k, k AS name, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, h FROM tree WHERE n = 1),
      top(k, level, pos, n, h, s) AS (SELECT k, 0, pos, n, h, '' FROM sub UNION ALL {climb.format('top')}),
      own AS ({sides.format(fan=fan, t='leaf', r='tree')}), outer_ AS ({sides.format(fan=fan, t='sub', r='top')}),
      folded AS (SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(coalesce(own.p, '') || coalesce(outer_.p, '')) AS proof_sha256,
        {fold.format(fold.format("coalesce(leaf.changed, leaf.h)", "own.steps"), "outer_.steps")} AS folded_root
        FROM leaf JOIN sub ON sub.name = leaf.k LEFT JOIN own ON own.id = leaf.id LEFT JOIN outer_ ON outer_.id = sub.id)
      SELECT *, folded_root = root AS verified FROM folded"""


__all__ = ["leaves", "manifest", "oracle", "placed"]
