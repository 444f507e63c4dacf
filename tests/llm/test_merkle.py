import zlib
from hashlib import sha256

import pytest

from veilspan.llm import merkle as M

LOW = {a: a + 32 for a in range(65, 91)}
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, k string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def climb(nodes, fan):
    """All levels of a tree, from the nodes to the one that is left."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def walk(levels, at, fan):
    """(left, right) siblings of a node on each level."""
    out = []
    for level in levels[:-1]:
        first = at - at % fan
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fan])))
        at //= fan
    return out


def brute(rows, fan=8):
    parts = {}
    for row in rows:
        parts.setdefault(row["lang"], []).append(row)
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        parts[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = climb([leaf(r) for r in parts[lang]], fan)
    top = climb([trees[x][-1][0] for x in langs], fan)
    out = []
    for at_lang, lang in enumerate(langs):
        for at, row in enumerate(parts[lang]):
            steps = walk(trees[lang], at, fan) + walk(top, at_lang, fan)
            h = leaf(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                h = leaf(row | {"text": row["text"].translate(LOW)})
            for left, right in steps:
                h = H(left, h, right)
            root = top[-1][0]
            out.append((row["doc_id"], leaf(row), trees[lang][-1][0], root, H(*(x for s in steps for x in s)), h, h == root))
    return sorted(map(str, out))


def rows_of(n, langs=("en", "de", None)):
    return [dict(doc_id=i * 3 % 101 + i, text=f"Text {i}" * (i % 4), lang=langs[i % 7 % len(langs)], source=None if i % 5 == 0 else "s", n_chars=i) for i in range(n)]


def made(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("n, fan, depth", [(1, 8, 4), (75, 2, 3), (140, 8, 1)])
def test_equals_brute_force_over_several_rounds(spark, n, fan, depth):
    rows = rows_of(n)
    got = M.manifest(made(spark, rows), fan, depth).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, fan)


def test_odd_rows(spark):
    odd = [
        dict(doc_id=None, text=None, lang=None, source=None, n_chars=None), dict(doc_id=None, text="", lang="", source="", n_chars=0),
        dict(doc_id=5, text="Ä日本A", lang="ü", source="s", n_chars=4), dict(doc_id=5, text="Ä日本A", lang="ü", source="s", n_chars=4),
        dict(doc_id=5, text="B" * 300_000, lang="ü", source="s", n_chars=4), dict(doc_id=-7, text="x", lang="zz", source="s", n_chars=1),
    ]
    got = M.manifest(made(spark, odd), 2, 1).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(odd, 2)
    assert M.manifest(made(spark, odd).limit(0)).count() == 0


def test_a_key_with_most_rows_and_many_keys(spark):
    rows = rows_of(40, ("en",)) + rows_of(28, tuple(f"l{i}" for i in range(7)))
    got = M.manifest(made(spark, rows), 4, 1).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 4)


def test_what_changed_is_found(spark):
    rows = [dict(doc_id=i, text="Abc", lang="en", source="s", n_chars=3) for i in range(30)]
    bad = {r.doc_id for r in M.manifest(made(spark, rows)).where("NOT verified").collect()}
    assert bad == {i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 0}
