import zlib

import numpy as np
import pytest

from veilspan.llm import pu_quality as Q
from veilspan.llm import toxic_cnn as T
from veilspan.sources.tables import read_table

SF = "/root/testdata/sf0.1"
ODD = [(5, None, 1.0), (6, "", 2.0), (7, "word " * 30000, 3.0), (None, "a b", 4.0), (7, "word " * 30000, 3.0)]


def held(rows, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    pairs = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return np.array(pairs)


def test_quality_on_held_out_rows(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    network, prior = Q.fit(docs, labels)
    assert 0.7 < prior <= 0.98
    pairs = held(Q.score(docs, network).collect(), labels, "quality")
    right = pairs[:, 0] == pairs[:, 1]
    assert right.mean() > 0.97 and right[pairs[:, 1] == 1].mean() > 0.99
    kept = Q.keep_quality(docs, network)
    assert kept.columns == docs.columns and 0.7 < kept.count() / docs.count() < 0.95


def test_toxicity_on_held_out_rows(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    model = T.fit(docs, labels)
    pairs = held(T.score(docs, model).collect(), labels, "toxic")
    toxic = pairs[:, 1] == 1
    assert pairs[toxic, 0].mean() > 0.7 and pairs[~toxic, 0].mean() < 0.02


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_odd_rows_and_no_labels(spark, label):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score double")
    none = spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(6, 1, 1), (7, 0, 0), (7, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        out = Q.score(docs, Q.fit(docs, labels)[0]) if label == "quality" else T.score(docs, T.fit(docs, labels))
        rows = out.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
        assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
        assert out.limit(0).count() == 0
    empty = docs.limit(0)
    assert (Q.score(empty, Q.fit(empty, none)[0]) if label == "quality" else T.score(empty, T.fit(empty, none))).count() == 0


def test_non_negative_risk_recovers_the_prior():
    rng = np.random.default_rng(0)

    def rows(n, good):
        x = rng.normal(0, 1, (n, Q.N_FEATURES))
        x[:, 0] += np.where(good, 3, -3)
        return x

    u = rows(4000, rng.random(4000) < 0.7)
    network, prior = Q.train(rows(2000, np.ones(2000, bool)), u, Q.PuSettings())
    assert abs(prior - 0.7) < 0.1
    fresh = rng.random(2000) < 0.5
    rank = np.argsort(np.argsort(network.logit(rows(2000, fresh))))
    good, bad = fresh.sum(), (~fresh).sum()
    assert (rank[fresh].sum() - good * (good - 1) / 2) / (good * bad) > 0.9


def test_convolution_equals_a_plain_loop():
    model = T.Cnn(T.CnnSettings())
    ids, _ = T._packed(["one two three four", "", "x", "été straße été"], T.Vocabulary(model.s))
    got = model.pooled(ids)
    for k, x in enumerate(ids):
        padded = np.r_[x, np.zeros(model.pad, np.int64)]
        want = []
        for w, f, b in zip(model.s.widths, model.filters, model.bias):
            e = model.embed(padded)
            r = [sum(e[i + j] @ f[j] for j in range(w)) + b for i in range(max(1, len(x)))]
            want.append(np.max(r, 0))
        assert np.allclose(got[k], np.concatenate(want), atol=1e-5)


def test_a_training_step_follows_the_numeric_gradient():
    """Each kind of parameter, by differences of the weighted log loss."""
    s = T.CnnSettings(words=6, prefixes=5, size=3, filters=2, widths=(1, 2))
    rng = np.random.default_rng(3)
    model = T.Cnn(s)
    for name in ("word", "start", "out"):
        setattr(model, name, rng.normal(0, 1, getattr(model, name).shape))
    model.word[0] = model.start[0] = 0
    model.filters, model.bias, model.base = [rng.normal(0, 1, f.shape) for f in model.filters], [rng.normal(0, 0.1, b.shape) for b in model.bias], 0.1
    ids, _ = T._packed(["one two three four five", "six seven", "a b c d e f"], T.Vocabulary(s))
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])

    def loss():
        z = model.logits(ids)
        return float((np.logaddexp(0, np.where(y == 1, -z, z)) * weight).sum())

    places = [(model.filters[1], (1, 0, 1)), (model.filters[0], (0, 2, 0)), (model.bias[1], (1,)), (model.out, (2,)), (model.out, (0,))]
    for x in ids:
        places += [(model.word, (int(x[0] >> 16), 1)), (model.start, (int(x[-1] & 0xFFFF), 2))]
    slopes = []
    for array, at in places:
        kept, h = array[at], 1e-5
        array[at] = kept + h
        up = loss()
        array[at] = kept - h
        slopes.append((up - loss()) / (2 * h))
        array[at] = kept
    before = [a[at] for a, at in places]
    model.step(ids, y, weight, 1e-6)
    assert max(map(abs, slopes)) > 0.01
    for (array, at), slope, old in zip(places, slopes, before):
        scale = 0.5 if array is model.word or array is model.start else 1.0  # embeddings move at half the rate
        extra = 1e-4 * old if array is model.out else 0.0  # the last layer decays
        assert abs((old - array[at]) / (1e-6 * scale) - (slope + extra)) < 1e-3 * max(1, abs(slope)), at


def test_toxicity_scores_equal_a_plain_pass(spark):
    """Every document, word by word, by the fitted parameters."""
    sf = "/root/testdata/sf0.001"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    for r in docs.limit(60).collect():
        words = T.WORD.findall((r.text or "").lower())
        looked = [model.word[x >> 16] + model.start[x & 0xFFFF] for x in T._packed([r.text], T.Vocabulary(model.s))[0][0]]
        padded = looked + [np.zeros(model.s.size)] * model.pad
        z, k = float(model.base), 0
        for w, f, b in zip(model.s.widths, model.filters, model.bias):
            for c in range(model.s.filters):
                top = max(sum(float(padded[i + j] @ f[j][:, c]) for j in range(w)) for i in range(max(1, len(words)))) + float(b[c])
                z, k = z + max(0.0, top) * float(model.out[k]), k + 1
        z -= model.shift[T.language_of(words)]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-3
    assert len(got) == docs.count()


def test_the_sample_is_bounded_by_bytes(spark):
    rows = [(i, f"word{i} " * (2000 if i % 7 == 0 else 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    seen = []
    whole = T.train
    try:
        T.train = lambda ids, y, tongues, s: seen.append((len(ids), sum(map(len, ids)), max(map(len, ids)))) or whole(ids, y, tongues, s)
        T.fit(docs, labels, T.CnnSettings(bytes=100_000, epochs=1))
    finally:
        T.train = whole
    n, words, longest = seen[0]
    assert n > 20 and words * 8 < 2 * 2 * 100_000 and longest == 2000  # long texts take part


def test_quality_scores_equal_a_plain_pass(spark):
    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    network, _ = Q.fit(docs, read_table(spark, sf, "labels"))
    got = {r.doc_id: r.score for r in Q.score(docs, network).collect()}
    w1, b1, w2, b2 = network.w
    for r in docs.limit(60).collect():
        x = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(Q.features((r.text or "").encode()).tolist(), network.mean, network.scale)]
        h = [np.tanh(sum(x[i] * w1[i, j] for i in range(len(x))) + b1[j]) for j in range(len(b1))]
        z = sum(a * b for a, b in zip(h, w2)) + b2[0]
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-6


def test_non_negative_risk_by_brute_force():
    """The best threshold of one feature under the risk, over all thresholds, cuts where the classes part."""
    rng = np.random.default_rng(1)
    p, good = rng.normal(2, 1, 1500), rng.random(4000) < 0.6
    u = rng.normal(np.where(good, 2, -2), 1)
    loss = lambda f: np.logaddexp(0, -f)

    def risk(cut, prior=0.6):
        fp, fu = 2 * (p - cut), 2 * (u - cut)
        return prior * loss(fp).mean() + max(0.0, loss(-fu).mean() - prior * loss(-fp).mean())

    best = min(np.linspace(-4, 4, 161), key=risk)
    x = lambda v: np.c_[v, np.zeros((len(v), Q.N_FEATURES - 1))]
    network, prior = Q.train(x(p), x(u), Q.PuSettings())
    grid = np.linspace(-4, 4, 161)
    cut = grid[np.argmin(np.abs(network.logit(x(grid))))]
    assert abs(prior - 0.6) < 0.1 and abs(cut - best) < 0.7


def test_rows_beyond_the_sample_are_learnt(spark):
    """A sign of toxicity that the start's sample hardly holds counts, and the cut is that of all rows set aside."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "four"], 12)) + (f" vile{i % 40}" if i % 4 == 0 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    seen, kept = [], T._cut
    try:
        T._cut = lambda model, rows: seen.append(rows.count()) or kept(model, rows)
        model = T.fit(docs, labels, T.CnnSettings(positives=30, negatives=60, epochs=2))
    finally:
        T._cut = kept
    assert 450 < seen[0] < 750  # a quarter of the learning folds' rows
    pairs = held(T.score(docs, model).collect(), labels, "toxic")
    toxic = pairs[:, 1] == 1
    assert pairs[toxic, 0].mean() > 0.8 and pairs[~toxic, 0].mean() < 0.1


def shuffled_bytes(spark, act):
    """Bytes that the stages of an action write for shuffles, and the action's result."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before, result = stages(), act()
    return sum(n for k, n in stages().items() if k not in before), result


def labelled_in_part(spark):
    """2,000 documents, an eighth of them labelled, and the number of their words."""
    rng = np.random.default_rng(2)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)])
    rows = [(i, " ".join(rng.choice(words, 300)) + (" vile" if i % 32 == 0 else "")) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([(i, 0, int(i % 32 == 0)) for i in range(0, 2000, 8)], "doc_id long, quality int, toxic int"), 2000 * 300


def test_fitting_shuffles_labelled_texts_alone(spark):
    """Neither unlabelled texts nor parameters that a shard left as they were are shuffled."""
    docs, labels, words = labelled_in_part(spark)
    docs = docs.localCheckpoint()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (kept, "-1"):  # labels that are broadcast or shuffled
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            n, _ = shuffled_bytes(spark, lambda: T.fit(docs, labels, T.CnnSettings(positives=10, negatives=20, epochs=1)))
            assert 0 < n < 0.5 * 4 * words  # a word is packed into four bytes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_a_bitmap_of_ids_loses_no_row(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 62), (1 << 63) - 1, 32767, 32768, 1 << 26]
    rows = spark.createDataFrame([(i, n) for n, i in enumerate([*ids, 7, None, *range(100_000, 101_000)])], "doc_id long, n int")
    wanted = spark.createDataFrame([(i,) for i in [*ids, 7, None, 5]], "doc_id long")
    got = T.samples.among(rows, wanted)
    assert got.columns == rows.columns and sorted(r.n for r in got.collect() if r.doc_id in ids) == list(range(11))
    assert got.count() <= 13
    assert T.samples.among(rows, wanted.limit(0)).count() == 0 == T.samples.among(rows.limit(0), wanted).count()


def test_a_full_bitmap_gives_the_same_model(spark):
    docs, labels, _ = labelled_in_part(spark)
    s, kept, models = T.CnnSettings(positives=10, negatives=20, epochs=1), T.samples.SLOTS, []
    try:
        for slots in (kept, 1):
            T.samples.SLOTS = slots
            models.append(T.fit(docs, labels, s))
    finally:
        T.samples.SLOTS = kept
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(*map(T._parameters, models))) and np.allclose(models[0].shift, models[1].shift)
