"""Streams: lines in any order over any batches, held text, idle streams, numbering, and batches that run again."""

import hashlib
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilspan.operators import report, vault
from veilspan.sources import events
from veilspan.streaming import clean, rehydrate, sinks
from veilspan.streaming import vault as streamed

NAMES = [("s", "[[A_1]]", "Ann"), ("s", "[[A_2]]", "x[[A_1]]"), ("t", "[[A_1]]", "Tom")]
LINES = "stream_id string, session string, seq long, line string"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streamed.STORE)


def delta(text, shape):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]} if shape else {"type": "content_block_delta", "delta": {"text": text}})


def lines_of(text, stream, session, cut, shape=True):
    parts = [text[i : i + cut] for i in range(0, len(text), cut)]
    lines = [delta(p, shape) for p in parts] + ['data: {"u": {"v": "to [[A_1]]", "n": 1e400}}', ": ping", "data: {broken", "data: [DONE]"]
    return [(stream, session, k, line) for k, line in enumerate(lines)]


def run(spark, batches, folder, idle=None):
    names = spark.createDataFrame(NAMES, "session string, placeholder string, value string")
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        lines = spark.readStream.schema(LINES).parquet(f"{folder}/in")
        query = rehydrate.restore_stream(lines, names, f"{folder}/out", f"{folder}/state", idle)
        if idle is None:
            query.awaitTermination()
            continue
        until = time.time() + 60
        while time.time() < until and len(texts_of(rehydrate.restored(spark, f"{folder}/out").orderBy("stream_id", "seq", "part").collect(), "a")) < 13:
            time.sleep(1)
        query.stop()
    return rehydrate.restored(spark, f"{folder}/out").orderBy("stream_id", "seq", "part").collect()


def texts_of(rows, stream):
    out = []
    for r in rows:
        if r.stream_id == stream and r.out.startswith("data: {") and ("delta" in r.out):
            body = json.loads(r.out[6:])
            out.append(body["choices"][0]["delta"]["content"] if "choices" in body else body["delta"]["text"])
    return "".join(out)


def test_lines_in_any_order_over_batches_give_the_text(spark, tmp_path):
    rng, rows = random.Random(2), []
    texts = {f"d{i}": ("s" if i % 3 else "t", "".join(rng.choices(["[[A_1]]", "[[A_2]]", "[[", "[", "]]", "é ", "word ", "[[B_9]]"], k=30))) for i in range(6)}
    for stream, (session, text) in texts.items():
        rows += lines_of(text, stream, session, rng.choice([1, 3, 7]), shape=len(rows) % 2 == 0)
    rows += rng.sample(rows, 10)  # some come twice
    rng.shuffle(rows)
    got = run(spark, [rows[k::3] for k in range(3)], str(tmp_path))
    for stream, (session, text) in texts.items():
        own = {p: v for s, p, v in NAMES if s == session}
        assert texts_of(got, stream) == rehydrate.restore(text, own), stream
        others = [r.out for r in got if r.stream_id == stream and "delta" not in r.out]
        assert others == [f'data: {{"u": {{"v": "to {own["[[A_1]]"]}", "n": 1e400}}}}', ": ping", "data: {broken", "data: [DONE]"]




def test_an_idle_stream_is_closed_with_what_was_held(spark, tmp_path):
    first = [("a", "s", 0, delta("to [[A", True)), ("a", "s", 2, delta("later", True))]
    got = run(spark, [[*first, ("a", "s", 3, delta("[[B", True)), ("b", "s", 0, delta("x", False)), ("b", "s", 1, "data: [DONE]")]], str(tmp_path), idle=2)
    assert texts_of(got, "a") == "to [[Alater[[B" and texts_of(got, "b") == "x"


def test_streamed_numbering_goes_on_and_a_hot_session_is_dealt_by_value(spark, tmp_path):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"s{i % 5}", i // 4, rng.randrange(50), rng.choice("AB"), f"v{rng.randrange(60)}") for i in range(240)]
    schema = "session string, turn long, start int, type string, value string"
    want = {(r.session, r.value): r.placeholder for r in vault.mint(spark.createDataFrame(rows, schema)).collect()}
    for part in (rows[:120], rows[120:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        streamed.mint_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = streamed.minted(spark, f"{tmp_path}/out").collect()
    assert {(r.session, r.value): r.placeholder for r in got} == want and len(got) == len(want)


def test_an_epoch_that_runs_again_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", "Y")], "source string, type string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    events.audit_sink(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    count = lambda: sorted(map(tuple, events.audit_counts(spark, f"{tmp_path}/out").collect()))
    assert count() == [("a", "X", 2), ("b", "Y", 1)]
    sinks.write_epoch(rows.groupBy("source", "type").agg(F.count("*").alias("n")), f"{tmp_path}/out", 0)
    assert count() == [("a", "X", 2), ("b", "Y", 1)] and events.audit_counts(spark, f"{tmp_path}/none").count() == 0


def test_sessions_over_ranges_equal_a_plain_walk(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.randrange(40) * 900, i) for i in range(500)]
    df = spark.createDataFrame(rows, "u string, t long, i int").withColumn("t", F.timestamp_seconds("t")).withColumn("extra", F.lit("x"))
    got = {r.i: r.session_no for r in report.sessions(df, "u", "t", "i").collect()}
    for user in {r[0] for r in rows}:
        last, n = None, 0
        for _, t, i in sorted((r for r in rows if r[0] == user), key=lambda r: r[1:]):
            n += last is not None and t - last > 3600
            last = t
            assert got[i] == n


def test_percentiles_by_selection_equal_sorting(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([7.0, rng.random() * 9, None])) for _ in range(400)] + [("one", 3.5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.p) for r in report.percentiles(df, "k", "v", (0.0, 0.31, 0.95, 1.0)).collect()}
    for key in {r[0] for r in rows} - {"none"}:
        held = sorted(v for k, v in rows if k == key and v is not None)
        spots = [p * (len(held) - 1) for p in (0.0, 0.31, 0.95, 1.0)]
        want = [held[int(h)] + (held[min(int(h) + 1, len(held) - 1)] - held[int(h)]) * (h - int(h)) for h in spots]
        assert got[key][0] == len(held) and all(abs(a - b) < 1e-9 for a, b in zip(got[key][1], want))
    assert "none" not in got and {r.k for r in report.latency(df, "k", "v").collect()} == {r[0] for r in rows}


def scan_at(df):
    return df.withColumn("spans", F.when(F.col("text").contains("@"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))


def plain_cache(batches, age, most, renew):
    """Batch by batch as a dict: (whether each row is skipped, the cache in the end)."""
    cache, skips = {}, []
    for batch in batches:
        marks = {}
        for text, ts in batch:
            skipped = text in cache and ts - cache[text] <= age
            skips.append((text, ts, skipped))
            if text is not None and "@" not in text and (renew or not skipped):
                marks[text] = max(marks.get(text, ts), ts)
        now = max([ts for _, ts in batch] + list(cache.values()))
        cache = {t: max(a for a in (cache.get(t), marks.get(t)) if a is not None) for t in {*cache, *marks}}
        cache = {t: a for t, a in cache.items() if now - a <= age}
        keep = sorted(cache, key=lambda t: (-cache[t], hashlib.sha256(f"p{t}".encode()).hexdigest()))[:most]
        cache = {t: cache[t] for t in keep}
    return skips, cache


@pytest.mark.parametrize("renew", [False, True])
def test_clean_cache_of_a_stream_equals_a_plain_one_and_loses_no_finding(spark, tmp_path, renew):
    rng = random.Random(9)
    texts = ["", "a@b", None, *(f"c{i}" for i in range(6))]
    batches = [[("hot" if rng.random() < 0.4 else rng.choice(texts), 10 * k + rng.randrange(15)) for _ in range(12)] for k in range(4)]
    schema = "text string, t long, extra string"
    for batch in batches:
        rows = spark.createDataFrame([(text, t, "x") for text, t in batch], schema).withColumn("ts", F.timestamp_seconds("t"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        go = clean.scan_stream(stream, scan_at, f"{tmp_path}/out", f"{tmp_path}/state", "p", age=12, most=4, renew=renew)
        go.awaitTermination()
    skips, held = plain_cache(batches, 12, 4, renew)
    got = clean.scanned_chunks(spark, f"{tmp_path}/out").collect()
    name = {hashlib.sha256(f"p{t}".encode()).hexdigest(): t for t in [*texts, "hot"] if t is not None}
    assert sorted((str(name.get(r.key)), r.t, r.skipped) for r in got) == sorted((str(t), s, k) for t, s, k in skips)
    assert all(r.spans is None if r.key is None else r.spans == ([1] if name[r.key] == "a@b" else []) for r in got)
    at = F.unix_timestamp("at").alias("at")
    assert {name[r.key]: r.at for r in clean.cached(spark, f"{tmp_path}/out").select("key", at).collect()} == held


class CountedMap(dict):
    """A map state that counts what crosses to the store."""

    calls = 0

    def getValue(self, key):
        CountedMap.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        CountedMap.calls += 1
        self[key] = value

    def removeKey(self, key):
        CountedMap.calls += 1
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class CountedHandle:
    def __init__(self):
        self.states = []

    def getMapState(self, *_):
        self.states.append(CountedMap())
        return self.states[-1]


def test_state_is_read_by_the_stream_and_not_by_the_line():
    """A frame holds many streams, whose lines come in two batches without order; calls of the state don't grow with lines."""
    rng, n, lines = random.Random(5), 40, 200
    rows = [(f"s{k}", "s", i, "delta" if i < lines - 1 else "done", "l", '{"choices": 1}' if i < lines - 1 else "[DONE]", f"{k}.{i} " if i < lines - 1 else None) for k in range(n) for i in range(lines)]
    rng.shuffle(rows)
    made, handle, got = rehydrate.Reassemble(), CountedHandle(), {}
    made.init(handle)
    CountedMap.calls = 0
    for half in (rows[::2], rows[1::2]):
        frame = pd.DataFrame(half, columns=["stream_id", "session", "seq", "kind", "line", "payload", "delta"])
        for out in made.handleInputRows((0,), iter([frame[:3000], frame[3000:]]), None):
            for r in out.itertuples():
                got.setdefault(r.stream_id, []).append(r)
    for k in range(n):
        assert [r.seq for r in got[f"s{k}"]] == list(range(lines))
        assert "".join(r.delta for r in got[f"s{k}"][:-1]) == "".join(f"{k}.{i} " for i in range(lines - 1))
    assert CountedMap.calls < 40 * n  # of 200 lines each
    assert not any(handle.states)


def handled(made, batches):
    """Rows that a processor gives for batches of (stream_id, session, seq, kind, line, delta), by stream, and the length of its longest frame."""
    got, longest = {}, 0
    for batch in batches:
        frame = pd.DataFrame(batch, columns=["stream_id", "session", "seq", "kind", "line", "delta"]).assign(payload='{"choices": 1}')
        for out in made.handleInputRows((0,), iter([frame[:700], frame[700:]]), None):
            longest = max(longest, len(out))
            for r in out.itertuples():
                got.setdefault(r.stream_id, []).append(r)
    return got, longest


def test_state_is_read_by_the_part_and_not_by_the_stream():
    """Calls of the state don't grow with streams, few lines as each may have."""
    rng, n, lines = random.Random(8), 600, 5
    rows = [(f"s{k}", "s", i, "delta" if i < lines - 1 else "done", "l", f"{k}.{i} " if i < lines - 1 else None) for k in range(n) for i in range(lines)]
    rng.shuffle(rows)
    made, handle = rehydrate.Reassemble(), CountedHandle()
    made.init(handle)
    CountedMap.calls = 0
    got, _ = handled(made, [rows[k::3] for k in range(3)])
    for k in range(n):
        assert [r.seq for r in got[f"s{k}"]] == list(range(lines)) and [r.delta for r in got[f"s{k}"][:-1]] == [f"{k}.{i} " for i in range(lines - 1)]
    assert CountedMap.calls < n and not any(handle.states)


def test_a_long_stream_is_never_held_whole(monkeypatch):
    """The first line comes last: lines wait in blocks, of which few are at hand, and go out in frames of bounded length."""
    monkeypatch.setattr(rehydrate, "MOST", 200)
    monkeypatch.setattr(rehydrate, "FRAME", 50)
    rng, lines, most = random.Random(9), 3000, 0
    rows = [("s", "s", i, "delta", "l", f"{i} ") for i in range(1, lines)]
    rng.shuffle(rows)

    class Watched(rehydrate.Reassemble):
        def _take(self, seq):
            nonlocal most
            most = max(most, sum(len(own) for block in self.blocks.values() for own in block.values()))
            return super()._take(seq)

    made, handle = Watched(), CountedHandle()
    made.init(handle)
    got, longest = handled(made, [rows[:1000], rows[1000:], [("s", "s", 0, "delta", "l", "0 "), ("s", "s", lines, "done", "l", None)]])
    assert [r.seq for r in got["s"]] == list(range(lines + 1)) and longest <= 50 and most < 200 + rehydrate.BLOCK
    assert not any(handle.states)


def test_only_lines_that_change_are_written_anew(spark):
    """Lines without a placeholder go on sign for sign; brackets written as escapes are seen, and texts that were cut are put in."""
    plain = 'data: {"choices":[{"delta":{"content":"a [1]"}}],  "n":1e400}'
    rows = [
        ("p", "s", 0, 1, "delta", plain, "a [1]", True), ("p", "s", 1, 1, "delta", delta("to [[A_1]]", True), "to [[A_1]]", True),
        ("p", "s", 2, 1, "delta", delta("b [", False), "b ", False), ("p", "s", 3, 1, "delta", delta("[[B_9]]", False), "[[B_9]]", True),
        ("p", "s", 4, 1, "json", r'data: {"u": "[[A_1]] é"}', None, True), ("p", "s", 5, 1, "json", 'data: {"u":  [1]}', None, True),
        ("p", "t", 6, 1, "json", 'data: {"u": "[[A_1]]"}', None, True), ("p", "s", 7, 1, "other", ": [[A_1]]", None, True), ("p", "s", 8, 1, "done", "data: [DONE]", None, True),
    ]
    names = spark.createDataFrame(NAMES, "session string, placeholder string, value string")
    pieces = spark.createDataFrame(rows, rehydrate.PIECES)
    got = {r.seq: r.out for r in rehydrate.restored_lines(pieces, names).collect()}
    own = {k: got.pop(k) for k in (1, 2, 3)}
    assert texts_of([type("Row", (), {"stream_id": "p", "out": own[k]}) for k in (1, 2, 3)], "p") == "to Annb [[B_9]]"
    assert got == {0: plain, 4: r'data: {"u": "Ann é"}', 5: rows[5][5], 6: 'data: {"u": "Tom"}', 7: rows[7][5], 8: rows[8][5]}
    assert pieces.where(rehydrate.changing()).count() == 5
