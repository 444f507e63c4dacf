import hashlib
import re
import time

from veilspan.llm.pii import find_pii, mod97, pii_digests
from veilspan.sources.tables import read_table
from pyspark.sql import functions as F


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


ROWS = [
    (1, "mail a.b@c.de_f@g.hi x@y@z.org, 🙂é jo.81@ex-a.co.uk. @@ a@b"), (2, None), (3, ""),
    (4, "hosts 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.0255 9.9.9"), (5, "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 4111  1111 1111 1111"),
    (6, "call +1 (555) 010-9999. +49 30 1234567890123 +12 +1-2-3-4-5-6-7-8-9-0)"), (7, "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765433 ssn 123-45-6789 order 123-45-6789x (555) 123-4567"),
    (8, "1.2.3.4 a@b.cd " * 3000), (9, "9" * 50000 + " a@" + "b." * 20000 + " +1" + " " * 30000 + "x@y.z"), (9, "é1.2.3.4é"), (9, "é1.2.3.4é"), (None, "+1 555 010 9999\n@"),
]


def test_base_spans_equal_the_plain_patterns(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in ROWS], "doc_id long, text string, spans string")
    got = pii_digests(df).collect()
    want = sorted((str(k), hashlib.sha256(plain(t or "").encode()).hexdigest()) for k, t in ROWS)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert "iban:5:32" in by[7].spans and "GB82" not in by[7].spans and by[7].n_more == 3
    assert by[7].max_score == 1 and by[5].n_card == 1 and by[3].max_score == 0
    assert pii_digests(df.limit(0)).count() == 0
    assert find_pii(df).where("doc_id = 5").first().spans[0].score == 0.95


def test_equals_the_plain_patterns_on_documents(spark):
    df = read_table(spark, "/root/testdata/sf0.01", "documents")
    want = {r.doc_id: hashlib.sha256(plain(r.text).encode()).hexdigest() for r in df.collect()}
    assert {r.doc_id: r.base_sha256 for r in pii_digests(df).collect()} == want


def test_mod97(spark):
    df = spark.createDataFrame([("DE89370400440532013000",), ("GB82WEST12345698765432",), ("GB82WEST12345698765433",)], "c string")
    assert [r[0] == 1 for r in df.select(mod97(F.col("c"))).collect()] == [True, True, False]


def test_no_python_in_the_plan(spark):
    plan = pii_digests(read_table(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_twenty_thousand_matches_in_one_text(spark):
    df = spark.createDataFrame([(1, "mail joe.doe@ex.co " * 20000)], "doc_id long, text string")
    pii_digests(df.limit(0)).collect()
    began = time.perf_counter()
    row = pii_digests(df).first()
    assert row.n_email == 20000 and row.max_score <= 1.0 and row.spans.endswith("email:379986:379999") and time.perf_counter() - began < 20
