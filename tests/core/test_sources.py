import json

from pyspark.sql import functions as F

from veilspan.functions import policy
from veilspan.operators import report, vault
from veilspan.operators.detect import detect
from veilspan.functions import spans as S
from veilspan.sources import corpus, events
from veilspan.streaming.vault import mint_stream, minted


def test_generated_corpus_is_recalled_whole_and_is_reproducible(spark):
    items = corpus.generate(spark)
    found = detect(items, "text").withColumn("caught", F.exists("spans", lambda s: S.value_of(F.col("text"), s).contains(F.col("value"))))
    assert all(r.recall == 1.0 and r.passed for r in report.recall(found).collect())
    assert sorted(map(tuple, items.collect())) == sorted(map(tuple, corpus.generate(spark).collect()))
    assert corpus.generate(spark, 7).subtract(items).count() > 100


def test_item_files(spark, tmp_path):
    items = [{"text": "ignore this, password = hunter2hunter2 and a@x.io", "planted": [{"value": "hunter2hunter2", "type": "T", "category_group": "secrets"}, {"value": "a@x.io", "type": "E", "category_group": "pii"}]}]
    (tmp_path / "prompt_injection.json").write_text(json.dumps(items))
    rows = corpus.read_items(spark, f"file://{tmp_path}").orderBy("value").collect()
    assert [(r.category, r.item_no, r.grp, r.value) for r in rows] == [("prompt_injection", 0, "pii", "a@x.io"), ("prompt_injection", 0, "secrets", "hunter2hunter2")]


def test_payloads_have_their_sizes_and_secrets(spark):
    rows = detect(corpus.payloads(spark, (1024, 51_200)), "text").collect()
    for r in rows:
        assert len(r.text) == r.size_bytes
        assert abs(sum(s.type == "GENERIC_SECRET" for s in r.spans) - r.size_bytes / 2048) <= 6


def test_sse_lines(spark):
    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}', 'data: {"type":"x","delta":{"text":"b"}}', "data: [DONE]", "data: {bad", 'data: {"n":1}', ": ping", ""]
    got = events.parse_sse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.kind, r.delta) for r in got] == [("delta", "a"), ("delta", "b"), ("done", None), ("raw", None), ("json", None), ("other", None), ("other", None)]


def test_status_tables(spark):
    assert dict(map(tuple, events.health(spark, {"ner": False, "llm": True}).collect()))["ner"] is False
    row = events.policy_table(spark, policy.DEFAULT_POLICY, "2024-01-01").first()
    assert row.policy_version.startswith("2024-01-01.") and json.loads(row.policy) == policy.DEFAULT_POLICY


def test_audit_sink(spark, tmp_path):
    spans = spark.createDataFrame([("s", "A"), ("s", "A"), ("t", "B")], "source string, type string")
    spans.write.parquet(f"{tmp_path}/in")
    events.audit_sink(spark.readStream.schema(spans.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert {(r.source, r.type, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("s", "A", 2), ("t", "B", 1)}


def test_cache_of_recent_keys(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:04:00"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-01 00:05:00")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.k for r in events.recent(df, "k", "ts", "2024-01-01 00:05:01").collect()] == ["c", "a"]
    assert [r.k for r in events.recent(df, "k", "ts", "2024-01-01 00:05:01", most=1).collect()] == ["c"]


def test_streamed_vault_goes_on_from_its_state(spark, tmp_path):
    schema = "session string, turn long, start int, type string, value string"
    batches = [[("s", 1, 0, "E", "a"), ("s", 1, 5, "E", "b"), ("t", 1, 0, "E", "a")], [("s", 2, 0, "E", "c"), ("s", 2, 4, "E", "a"), ("s", 2, 9, "P", "x")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        mint_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {(r.session, r.value): r.placeholder for r in minted(spark, f"{tmp_path}/out").collect()}
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r.session, r.value): r.placeholder for r in vault.mint(everything.withColumn("end", F.col("start") + 1)).collect()}
    assert got == want and got[("s", "a")] == "[[E_2]]" and got[("s", "c")] == "[[E_3]]"
