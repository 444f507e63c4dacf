"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within the radius differ in few bits of at
least one segment (pigeonhole), so every segment value is indexed under its own Hamming ball of
radius one, and two segments that differ in two bits or fewer meet under a common key. Complete
distances are then verified among those that meet. With s segments all pairs within 3s - 1 bits meet.

Distinct texts with equal fingerprints are one node, so copies cost one row. A table of the index
is dealt by segment and by the segment's leading bits; the ball's flips of trailing bits stay in the
same part and are made there, only flips of leading bits are sent to other parts. A part above a
bound is cut into chunks, and each pair of chunks is a task. Wide segments are searched by sorted
keys, narrow ones, whose values nearly all occur, by comparing the groups of near values as blocks.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.arrow import arrow_schema, map_columns
from veilspan.llm.components import connected_components
from veilspan.session import materialize

#: Nodes that one part of the index holds on average; and of narrow segments. Leading bits that a part has at least.
PART_NODES, NARROW_NODES, LEAST_LEAD = 1 << 15, 1 << 16, 3
#: Keys of wide segments, or rows of narrow ones, above which a part is cut into chunks.
PART_KEYS, NARROW_ROWS = 1 << 22, 1 << 20
#: Bits of the widest segment that counts as narrow.
NARROW = 16
#: Pairs compared at once, pairs above which a block is first thinned by pivots, and links held before they are joined.
BLOCK, THICK, HELD = 1 << 17, 1 << 22, 1 << 19
#: Members of a key up to which all pairs are verified at once; larger ones are searched breadth first.
SMALL = 64


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; fewer words make one shingle, none no shingle."""
    words = text.lower().split()  # bytes: lower() takes A-Z only, split() the six ASCII white-space signs
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], seed) for a, b in zip(starts, starts[size:])], np.uint64)


def shingle_hashes_wide(text: bytes, size: int, seed: int) -> np.ndarray:
    """As shingle_hashes, but XXH3 of 128 bits: rows of two words."""
    words = text.lower().split()
    if not words:
        return np.empty((0, 2), np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh3_128_digest
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    ends = starts[min(size, len(words)) :]
    return np.frombuffer(b"".join([digest(line[a : b - 1], seed) for a, b in zip(starts, ends)]), "<u8").reshape(-1, 2)


def majority_bits(hashes: np.ndarray) -> bytes:
    """The fingerprint as big-endian bytes: a bit is 1 if set in over half the hashes."""
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    votes = np.zeros(octets.shape[1] * 8, np.int64)
    for at in range(0, len(octets), 4096):
        votes += np.unpackbits(octets[at : at + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes()[::-1]


def fingerprints(df: DataFrame, shingle: int, bits: int, seed: int) -> DataFrame:
    """(doc_id, fp binary of bits / 8 bytes) for each row; no words give the fingerprint zero."""
    hashes = shingle_hashes if bits == 64 else shingle_hashes_wide

    def make():
        def one(text):
            found = hashes(text or b"", shingle, seed)
            return majority_bits(found) if len(found) else bytes(bits // 8)

        return lambda keys, texts: (keys, [one(t) for t in texts])

    columns = [df["doc_id"].cast("long").alias("doc_id"), df["text"].cast("binary").alias("text")]
    return map_columns(df, columns, "doc_id long, fp binary", make)


def default_radius(bits: int) -> int:
    """The distance of an estimated cosine similarity of 0.8."""
    return int(bits * np.arccos(0.8) / np.pi)


def segments_for(bits: int, n_nodes: int | None = None, radius: int | None = None) -> int:
    """The fewest segments that are lossless up to the radius; the number of nodes plays no part."""
    return (default_radius(bits) if radius is None else radius) // 3 + 1


def _segments(bits: int, count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths of 63 bits at most."""
    cuts = [bits * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _values(words: np.ndarray, first: int, width: int) -> np.ndarray:
    """The segment as numbers; a segment may span two words."""
    word, shift = divmod(first, 64)
    value = words[:, word] >> np.uint64(shift)
    if shift + width > 64:
        value = value | (words[:, word + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << width) - 1)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star forest of local edges: (node index, smallest index it reaches)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while not np.array_equal(label, hop := label[label]):
            label = hop
        left = label[x] != label[y]
        x, y = x[left], y[left]
    mine = label != np.arange(len(nodes))
    return nodes[mine], nodes[label[mine]]


def _distances(words: np.ndarray, i, j) -> np.ndarray:
    return np.bitwise_count(words[i] ^ words[j]).sum(-1, dtype=np.int32)


def _breadth_first(words: np.ndarray, members: np.ndarray, radius: int) -> tuple[list, list]:
    """Links that join each cluster of ``members``: every one is compared with all not yet reached."""
    a, b = [], []
    rest = members
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _distances(words, rest, at) <= radius
            if near.any():
                hit = rest[near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                queue.extend(hit.tolist())
                rest = rest[~near]
    return a, b


def _part_links(words: np.ndarray, keys: np.ndarray, who: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that share a key, as a star forest over indices into ``words``."""
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[heads, len(keys)])
    a, b = [], []
    wide = sizes > SMALL
    tail = np.repeat(heads + sizes, sizes)
    narrow = np.repeat(~wide, sizes)
    place = np.arange(len(keys))
    for shift in range(1, int(sizes[~wide].max(initial=1))):
        i = np.flatnonzero(narrow & (place + shift < tail))
        for at in range(0, len(i), 1 << 20):
            x, y = who[i[at : at + (1 << 20)]], who[i[at : at + (1 << 20)] + shift]
            near = (x != y) & (_distances(words, x, y) <= radius)
            a.append(x[near])
            b.append(y[near])
    for head, size in zip(heads[wide].tolist(), sizes[wide].tolist()):
        more = _breadth_first(words, np.unique(who[head : head + size]), radius)
        a += more[0]
        b += more[1]
    none = np.empty(0, np.int64)
    return _forest(np.concatenate([none, *a]), np.concatenate([none, *b]))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the half-open ranges, one range after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class _Blocks:
    """Links among blocks of rows; ``words`` has a contiguous row for each word."""

    def __init__(self, words: np.ndarray, radius: int):
        self.words, self.radius, self.a, self.b, self.held = words, radius, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > HELD:
            a, b = self.forest()
            self.a, self.b, self.held = [a], [b], 0

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        return _forest(np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))

    def near(self, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        far = np.zeros((len(g), len(c)), np.uint8)
        for w in self.words:
            far += np.bitwise_count(w[g][:, None] ^ w[c][None, :])
        return far <= self.radius

    def compare(self, g: np.ndarray, c: np.ndarray) -> None:
        """Connects all within the radius between ``g`` and ``c``.

        A thick block is thinned first: rows near one pivot are joined to it and need no comparison
        with each other, which leaves (near of g, rest of c) and (rest of g, c)."""
        stack = [(g, c)]
        while stack:
            g, c = stack.pop()
            if len(g) * len(c) > THICK:
                pivot = g[len(g) // 2 : len(g) // 2 + 1]
                ng, nc = self.near(pivot, g)[0], self.near(pivot, c)[0]
                if 10 * int(ng.sum()) * int(nc.sum()) > len(g) * len(c):
                    for hit in (g[ng], c[nc]):
                        self.add(np.full(len(hit), pivot[0]), hit)
                    stack += [(g[ng], c[~nc]), (g[~ng], c)]
                    continue
            wide = max(1, min(len(c), BLOCK // 16))
            tall = max(1, BLOCK // wide)
            for i in range(0, len(g), tall):
                for j in range(0, len(c), wide):
                    x, y = np.nonzero(self.near(g[i : i + tall], c[j : j + wide]))
                    x, y = g[i + x], c[j + y]
                    if (x != y).any():
                        self.add(x[x != y], y[x != y])


def _narrow_links(words: np.ndarray, trail: np.ndarray, flip: np.ndarray, top: int, lead: int, width: int, radius: int):
    """Links in a part of narrow segments, as _part_links. trail has ``width`` bits below the ``lead`` bits.

    Two rows of which flips of leading bits brought one or both here meet in another part as well;
    the part whose lower flipped bit is 0 compares them."""
    code = (flip.astype(np.int64) + 1 << width) | trail.astype(np.int64)
    order = np.argsort(code, kind="stable")
    at = np.searchsorted(code[order], np.arange((lead + 1 << width) + 1))
    ones = [0, *(1 << k for k in range(width))]
    twos = np.array(ones + [1 << i | 1 << j for i in range(width) for j in range(i)])
    ones = np.array(ones)
    here = [i for i in range(lead) if not top >> i & 1]
    blocks = _Blocks(np.ascontiguousarray(words[order].T), radius)
    for t in np.flatnonzero(np.diff(at[: (1 << width) + 1])):
        own = t ^ twos
        codes = np.concatenate([own[own >= t], *((i + 1 << width) | (t ^ ones) for i in here)])
        blocks.compare(np.arange(at[t], at[t + 1]), _ranges(at[codes], at[codes + 1]))
    for i in here:
        for t in np.flatnonzero(np.diff(at[i + 1 << width : (i + 2 << width) + 1])):
            codes = (np.arange(i + 2, lead + 1) << width) | t
            blocks.compare(np.arange(at[(i + 1 << width) | t], at[((i + 1 << width) | t) + 1]), _ranges(at[codes], at[codes + 1]))
    a, b = blocks.forest()
    return order[a], order[b]


def link_nodes(nodes: DataFrame, n_nodes: int, bits: int, segments: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect all of ``nodes`` (node long, fp binary) that meet and lie within ``radius``.

    fp must differ from row to row. Edges form star forests within each task, so their number is at
    most the nodes' times the tasks a node is in; two nodes are connected by edges if and only if a
    chain of verified links connects them. Parts are counted first, and large ones cut into chunks
    by the node's hash."""
    cuts = _segments(bits, segments)
    narrow = max(w for _, w in cuts) <= NARROW
    mean, most = (NARROW_NODES, NARROW_ROWS) if narrow else (PART_NODES, PART_KEYS)
    lead = min(max(LEAST_LEAD, (max(1, n_nodes) // mean).bit_length()), min(w for _, w in cuts) - 1)
    size = bits // 64
    names = [f"w{k}" for k in range(size)]

    def parts_of(words):
        """(part, row, flip) of each row's places in the index, flip -1 for its own part."""
        parts, rows, flipped = [], [], []
        for s, (first, width) in enumerate(cuts):
            top = (_values(words, first, width) >> np.uint64(width - lead)).astype(np.int64)
            for flip in range(-1, lead):
                parts.append((s << lead) | (top ^ (1 << flip if flip >= 0 else 0)))
                rows.append(np.arange(len(words)))
                flipped.append(np.full(len(words), flip))
        return np.concatenate(parts), np.concatenate(rows), np.concatenate(flipped)

    def unpack(fp):
        return np.frombuffer(b"".join(fp), ">u8").astype(np.uint64).reshape(-1, size)

    def count():
        def apply(fp):
            part, _, flip = parts_of(unpack(fp))
            keys = np.where((flip < 0) & (not narrow), 1 - lead + np.array([w for _, w in cuts])[part >> lead], 1)
            found, at = np.unique(part, return_inverse=True)
            return found, np.bincount(at, keys, len(found)).astype(np.int64)

        return apply

    counts = map_columns(nodes, [nodes["fp"]], "part int, n long", count).groupBy("part").agg(F.sum("n").alias("n"))
    chunks = {r.part: -(-2 * r.n // most) for r in counts.where(F.col("n") > most).collect()}

    def deal():
        def apply(node, fp):
            words, node = unpack(fp), np.array(node, np.int64)
            part, row, flip = parts_of(words)
            tile = np.zeros(len(part), np.int64)
            if chunks:
                k = np.array([chunks.get(p, 1) for p in range(segments << lead)])[part]
                mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                mine = (mixed[row] % k.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(part)), k)
                other = _ranges(np.zeros(len(k), np.int64), k)
                part, row, flip, mine = part[again], row[again], flip[again], mine[again]
                tile = np.minimum(mine, other) << 31 | np.maximum(mine, other)
            return part.astype(np.int32), tile, node[row], flip.astype(np.int32), *words[row].view(np.int64).T

        return apply

    columns = "".join(f", {n} long" for n in names)
    dealt = map_columns(nodes, [nodes["node"], nodes["fp"]], f"part int, tile long, node long, flip int{columns}", deal)
    out = arrow_schema("a long, b long")

    def link(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        words = np.stack([table[n].to_numpy() for n in names], 1).view(np.uint64)
        flip = table["flip"].to_numpy()
        part = table["part"][0].as_py()
        first, width = cuts[part >> lead]
        value = _values(words, first, width)
        if narrow:
            trail = value & np.uint64((1 << width - lead) - 1)
            a, b = _narrow_links(words, trail, flip, part & (1 << lead) - 1, lead, width - lead, radius)
            return pa.table([node[a], node[b]], schema=out)
        own = np.flatnonzero(flip < 0)
        keys, who = [value[own]], [own]
        for bit in range(width - lead):
            keys.append(value[own] ^ np.uint64(1 << bit))
            who.append(own)
        far = np.flatnonzero(flip >= 0)
        keys.append(value[far] ^ (np.uint64(1) << (flip[far] + width - lead).astype(np.uint64)))
        who.append(far)
        a, b = _part_links(words, np.concatenate(keys), np.concatenate(who), radius)
        return pa.table([node[a], node[b]], schema=out)

    return dealt.groupBy("part", "tile").applyInArrow(link, "a long, b long")


def near_duplicates(
    df: DataFrame, shingle: int = 5, bits: int = 128, segments: int | None = None, radius: int | None = None, seed: int = 42
) -> DataFrame:
    """(doc_id, fp binary, component_id): the class of each document under chains of near fingerprints.

    component_id is the smallest doc_id reachable, the document's own included. The default radius
    links estimated cosine similarities of the shingle counts of 0.8 or more; a Jaccard similarity j
    of sets is a cosine of about 2j / (1 + j), so 0.8 by Jaccard lies well inside. The search is
    lossless where radius < 3 * segments, as it is by default at every size; with fewer segments,
    pairs are missed whose bits differ in three or more places of every segment.

    Null texts and texts without words have fingerprint zero and are linked like any other. Rows with
    a null doc_id keep their fingerprint, join no class and get a null component. Repeated rows give
    repeated rows of one class; classes that have the same smallest doc_id, as where one id has
    several texts, count as one. An empty table gives an empty table; columns other
    than doc_id and text aren't read."""
    if radius is None:
        radius = default_radius(bits)
    prints = materialize(fingerprints(df, shingle, bits, seed))
    classes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    n_nodes = classes.count()
    links = link_nodes(classes, n_nodes, bits, segments or segments_for(bits, n_nodes, radius), radius)
    found = connected_components(links)
    named = classes.join(found, classes["node"] == found["node"], "left").select(
        "fp", F.coalesce("component", classes["node"]).alias("component_id")
    )
    out = prints.where("doc_id is not null").join(named, "fp").select("doc_id", "fp", "component_id")
    return out.unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))


def fingerprint_hex(column: str = "fp") -> Column:
    """A fingerprint's number in lowercase hex."""
    return F.lower(F.hex(F.col(column)))
