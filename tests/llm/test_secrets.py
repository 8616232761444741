import hashlib
import re

from pyspark.sql import functions as F

from quarry.llm.secrets import MASK, dictionary, findings, labelled, op5_secret_scan, redact, scan


def test_planted_secrets_are_found(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_secret_scan(spark, sf).collect()
    assert all(texts[r.doc_id][r.start : r.start + len(r.value)] == r.value for r in got)
    want = {(k, m) for k, t in texts.items() for m in re.findall(r'(?i)token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|\b(AKIA[A-Z0-9]{16})\b', t) for m in m if m}
    assert {(r.doc_id, r.value) for r in got if r.is_secret} == want
    assert any(not r.is_secret for r in got)


def test_learned_from_given_labels(spark):
    rows = [(i, f"the key = {hashlib.md5(str(i).encode()).hexdigest()} is here, see host{i}.mail.example.com now", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = findings(docs).withColumn("label", F.col("value").rlike("^[0-9a-f]{32}$").cast("double"))
    new = spark.createDataFrame([(900, "the key = " + hashlib.md5(b"x").hexdigest() + " at host9.mail.example.com", "t")], docs.schema)
    got = {r.value: r.is_secret for r in scan(new, known.cache()).collect()}
    assert got == {hashlib.md5(b"x").hexdigest(): True, "host9.mail.example.com": False}


def test_held_out_precision_and_recall(spark):
    """Learned from three quarters of the documents, measured on the last; the names that label are no feature of their own."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    known = labelled(findings(docs.where(~held)))
    got = scan(docs.where(held), known.cache()).groupBy("label", "is_secret").count().collect()
    n = {(r.label, r.is_secret): r["count"] for r in got}
    hit, lost, wrong = (n.get(k, 0) for k in ((1.0, True), (1.0, False), (0.0, True)))
    assert hit >= 40 and hit / (hit + lost) >= 0.98 and hit / (hit + wrong) >= 0.98


def test_masking_keeps_columns_and_places(spark):
    docs = spark.createDataFrame([(1, "pin=1234 and 1234; password=longsecret1 longsecret1", 7, "x"), (1, "other", 8, None), (None, None, 9, "y")], "doc_id long, text string, _id int, `_spots` string")
    found = spark.createDataFrame([(1, 4, "1234", True), (1, 28, "longsecret1", True), (1, 30, "ngsecret1", False)], "doc_id long, start long, value string, is_secret boolean")
    got = redact(docs, found)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "pin=[SECRET] and 1234; password=[SECRET] [SECRET]", 7, "x"), (1, "other", 8, None), (None, None, 9, "y")], key=str)


def test_odd_rows(spark):
    key = "AKIA" + "Z9" * 8
    rows = [(1, None, 1.0), (2, "", 1.0), (None, f"{key} x", 1.0), (3, "word " * 60_000 + f'secret: "{"a1" * 12}".', None), (3, "plain", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = scan(docs)
    assert sorted((r.doc_id or 0, r.value, r.is_secret) for r in found.collect()) == [(0, key, True), (3, "a1" * 12, True)]
    clean = [r.text for r in redact(docs, found).collect()]
    assert f"{MASK} x" in clean and "plain" in clean and None in clean and any(t and t.endswith(f'secret: "{MASK}".') for t in clean)
    assert scan(docs.limit(0)).count() == 0 and redact(docs, found).columns == docs.columns
    assert [r.word for r in dictionary(docs, 1).collect()] == ["word"]
    assert labelled(findings(docs)).where("label = 1").count() == 2
