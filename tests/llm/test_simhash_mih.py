import numpy as np
import xxhash

from veilspan.llm.components import connected_components
from veilspan.llm import simhash_mih
from veilspan.llm.simhash_mih import _forest, fingerprint_hex, link_nodes, near_duplicates, segments_for
from veilspan.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def contract(text):
    words = (text or "").lower() if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def classes(prints, radius=4):
    """Smallest id reachable, by comparing all with all."""
    ids = sorted(prints)
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: top(i) for i in ids}


def run(df):
    found = near_duplicates(df, shingle=4, bits=64, segments=2, radius=4)
    return found.select("doc_id", fingerprint_hex().alias("f"), "component_id").collect()


def test_equals_brute_force(spark):
    df = read_table(spark, SF, "documents")
    rows = df.select("doc_id", "text").collect()
    near = [(10_000 + i, rows[0].text[: -i * 3]) for i in range(1, 30)]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    prints = {r[0]: contract(r[1]) for r in [*rows, *near]}
    want = classes(prints)
    assert {r.doc_id: (r.f, r.component_id) for r in run(df)} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, " \n ", 2), (9, "one two", 3), (9, "one two", 3), (None, "one two", 4), (7, "ONE\ttwo", 5), (8, "Été " * 50000, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((str(r.doc_id), r.component_id, r.f) for r in run(df)))
    by = {g[0]: g[1:] for g in got}
    assert by["5"] == by["3"] == (3, "0" * 16) and by["9"][0] == 7 and by["None"][0] is None and len(got) == 7
    assert by["7"][1] == f"{xxhash.xxh64_intdigest(b'one two', 42):016x}"
    assert run(df.limit(0)) == []


def test_links_are_lossless_within_the_pigeonhole_bound(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set()
    for c in centres.tolist():
        for _ in range(12):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(c ^ sum(1 << int(b) for b in bits))
    prints = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()], "node long, fp binary")
    for claimed in (len(prints), 1 << 18):  # one part, and many
        edges = link_nodes(df, claimed, 64, 2, 4)
        got = {r.node: r.component for r in connected_components(edges).collect()}
        assert {i: got.get(i, i) for i in prints} == classes(prints)


def within_radius_26(rng, families, members):
    """Node to fingerprint of 128 bits: families whose members lie 0 to 26 bits from a centre, centres 52 or so apart."""
    prints = set()
    for _ in range(families):
        centre = int.from_bytes(rng.bytes(16), "big")
        prints |= {centre ^ sum(1 << int(b) for b in rng.choice(128, rng.integers(0, 27), replace=False)) for _ in range(members)}
    return dict(enumerate(sorted(prints)))


def test_wide_radius_is_lossless_at_every_size(spark, monkeypatch):
    """Plain distance is the measure, whatever the number of nodes says and however parts are cut."""
    rng = np.random.default_rng(11)
    prints = within_radius_26(rng, 150, 2) | {10_000 + i: p for i, p in within_radius_26(rng, 1, 400).items()}
    want = classes(prints, 26)
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(16, "big"))) for i, p in prints.items()], "node long, fp binary")

    def found(claimed):
        edges = link_nodes(df, claimed, 128, segments_for(128, claimed), 26)
        got = {r.node: r.component for r in connected_components(edges).collect()}
        return {i: got.get(i, i) for i in prints}

    for claimed in (len(prints), 1 << 18, 1 << 24):
        assert found(claimed) == want
    monkeypatch.setattr(simhash_mih, "NARROW_ROWS", 150)
    monkeypatch.setattr(simhash_mih, "THICK", 50)
    monkeypatch.setattr(simhash_mih, "HELD", 20)
    assert found(1 << 18) == want


def test_large_parts_are_cut_into_chunks_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(6)
    prints = set()
    for c in rng.integers(0, 2**63, 5, dtype=np.uint64).tolist():
        prints |= {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(60)}
    prints = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, bytearray(p.to_bytes(8, "big"))) for i, p in prints.items()], "node long, fp binary")
    monkeypatch.setattr(simhash_mih, "PART_KEYS", 1500)
    edges = link_nodes(df, len(prints), 64, 2, 4)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {i: got.get(i, i) for i in prints} == classes(prints)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2000), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(df.limit(0)).count() == 0


def test_forest_keeps_connections():
    a, b = _forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 5: 1, 9: 8}
