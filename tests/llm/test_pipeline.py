import hashlib

import numpy as np
import tiktoken

import corpus_pipeline as P
from veilspan.llm import bpe_monoid, pu_quality, secret_scan, simhash_mih, source_mix
from veilspan.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def top(label, i):
    while label[i] != i:
        i = label[i]
    return i


def test_run_equals_brute_force_stage_by_stage(spark):
    docs = read_table(spark, SF, "documents")
    network, _ = pu_quality.fit(docs, read_table(spark, SF, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = [i for i in sorted(rows) if 1 / (1 + np.exp(-network.logit(pu_quality.features(rows[i].text.encode())[None].astype(float))[0])) >= 0.3]
    prints = {}
    for i in good:
        h = simhash_mih.shingle_hashes_wide(rows[i].text.encode(), 5, 42)
        prints[i] = int.from_bytes(simhash_mih.majority_bits(h), "big") if len(h) else 0
    label = {i: i for i in good}
    for i in good:
        for j in good:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 26:
                a, b = sorted((top(label, i), top(label, j)))
                label[b] = a
    first = [i for i in good if top(label, i) == i]
    clean = {i: secret_scan.redact(rows[i].text, secret_scan.find_secrets(rows[i].text)) for i in first}
    frame = spark.createDataFrame([(i, clean[i], rows[i].lang, rows[i].source, len(clean[i])) for i in first], docs.schema)
    mixed = {r.doc_id for r in source_mix.calibrated(frame, P.MIX).collect() if r.selected}
    path, pattern = bpe_monoid.public_tokenizer()
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe_monoid.load_ranks(path)[0], special_tokens={}).encode_ordinary
    want = {i: (encode(clean[i]), hashlib.sha256(clean[i].encode()).hexdigest()) for i in mixed}
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in P.run(spark, SF).collect()}
    assert got == want and len(first) < len(good) < len(rows)


def test_stages_on_odd_rows(spark):
    schema = read_table(spark, SF, "documents").schema
    text = "the quick brown fox jumps over the lazy dog and runs away from it all today"
    rows = [(1, text, "en", "src0", 75), (2, text, "en", "src0", 75), (3, None, None, None, None), (4, "", None, "s", 0), (None, text, "en", "src0", 75), (5, "a " * 50000, "en", "src1", 100000), (1, text, "en", "src0", 75)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, docs.limit(0), SF).count() == 0
        out.collect()
    kept = [r.doc_id for r in P.simhash_near_dedup(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == ["1", "3", "5", "None"]
    assert P.byte_bpe(spark, docs, SF).count() == len(rows)


def test_near_copies_of_four_fifths_are_caught(spark):
    """Recall of the stage's parameters on pairs whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    rng = np.random.default_rng(9)
    rows, near = [], 0
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = list(words)
        for at in rng.choice(300, rng.integers(1, 9), replace=False):
            other[at] = "changed"
        sets = [{tuple(w[i : i + 5]) for i in range(296)} for w in (words, other)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
            near += 1
    found = simhash_mih.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hits = sum(r.doc_id % 2 == 1 and r.component_id == r.doc_id - 1 for r in found)
    assert near > 200 and hits >= 0.95 * near
    assert all(r.component_id // 2 == r.doc_id // 2 for r in found)
