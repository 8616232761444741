from pyspark.sql import functions as F

from quarry.llm.secrets import MASK, findings, labelled, redact, scan

A, B, C = "ghp_" + "a1B2c3" * 6, "0123456789abcdef0123", "AKIA" + "Q7" * 8
TEXTS = {
    1: f'{{"k":"{A}","host":"very-long-host-name"}}',
    2: f"see https://x.org/?token={B}&next=very-long-page-name&key={C} now",
    3: f"token={B},password={C[::-1]}xy,host=a",
    4: "password=S3cr3t!pw and pwd: 'two words 9' end",
    5: 'secret = "correcthorse", "api-key":"p@ss,w0rd"',
    6: "The secret: patience. The author: somebody-or-other",
    7: f"{B};{A}",
    8: f"twice {B},{B}",
    9: f"-----BEGIN RSA PRIVATE KEY-----\nMIIE{B}\nqwertyui\n-----END RSA PRIVATE KEY-----\nand ssh://bob:s3cret@host:22/ or ftp://al:{A}@h",
    10: f'a={C}&b={C[::-1]} {{"a_token":"{A}","api_key":"c3d4e5f6"}} "api_key":"abcdefghijklmnopqrstuvwx" pwd=x9z',
}
KEY = TEXTS[9].split("\nand")[0]
WANT = {
    1: {A},
    2: {B, C},
    3: {B, C[::-1] + "xy"},
    4: {"S3cr3t!pw", "two words 9"},
    5: {"correcthorse", "p@ss,w0rd"},
    6: set(),
    7: {A},
    8: set(),
    9: {KEY, "s3cret", A},
    10: {C, A, "c3d4e5f6", "abcdefghijklmnopqrstuvwx"},
}


def test_every_run_and_value(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    rows = labelled(findings(docs)).collect()
    assert all(TEXTS[r.doc_id][r.start : r.start + len(r.value)] == r.value for r in rows)
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    got = {k: {r.value for r in rows if r.doc_id == k and r.label == 1} for k in TEXTS}
    assert got == WANT
    assert sorted((r.value, r.start) for r in rows if r.doc_id in (7, 8)) == sorted([(B, 0), (A, 21), (B, 6), (B, 27)])
    names = {(r.doc_id, r.value): (r.name, r.before1, r.after1) for r in rows}
    assert names[2, C] == ("key", "key", "now") and names[2, B] == ("token", "token", "next")


def test_redacted(spark):
    docs = spark.createDataFrame([(k, TEXTS[k]) for k in (3, 4, 5, 9, 10)], "doc_id long, text string")
    found = labelled(findings(docs)).withColumn("is_secret", F.col("label") == 1)
    clean = {r.doc_id: r.text for r in redact(docs, found).collect()}
    assert clean[3] == f"token={MASK},password={MASK},host=a" and clean[4] == f"password={MASK} and pwd: '{MASK}' end" and clean[5] == f'secret = "{MASK}", "api-key":"{MASK}"'
    assert clean[9] == f"{MASK}\nand ssh://bob:{MASK}@host:22/ or ftp://al:{MASK}@h"
    assert clean[10] == f'a={MASK}&b={C[::-1]} {{"a_token":"{MASK}","api_key":"{MASK}"}} "api_key":"{MASK}" pwd=x9z'
    assert {r.value for r in scan(docs).collect()} >= WANT[3] | WANT[4] | WANT[5]
