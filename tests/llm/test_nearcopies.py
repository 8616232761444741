import random
import re

import corpus_pipeline as P
from pyspark.sql import functions as F
from quarry.llm import nearcopies
from quarry.llm.nearcopies import near_copies


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def brute(texts):
    """Index -> least index of its group, every pair compared."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    near = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a]) if 5 * len(x & y) >= 4 * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def grouped(keys):
    out = {}
    for i, k in enumerate(keys):
        out.setdefault(k, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_edited_texts(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["", " \n", "one", "One", "a b c d e", "A b  c d e", "a b c d e f"]
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 9, 30, 200, 900]))]
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(words[: len(words) - rng.choice([0, 0, 1, 5])]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = grouped(brute(texts))
    assert 1 < max(map(len, want)) and len(want) > 40
    for one_in, most in ((1, 1_000_000), (3, 5)):
        got = {r.doc_id: r.component_id for r in near_copies(docs, one_in=one_in, most=most).collect()}
        assert grouped(got[i] for i in range(len(texts))) == want
    small = nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda *a: small(*a, most=3))
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert grouped(got[i] for i in range(len(texts))) == want


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label = brute([t for _, t in rows])
    got = P.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(rows[i][0] for i in set(label))


def test_rows_of_one_id(spark):
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (7, "another text of quite other words"), (8, "ONE two three four five six"), (None, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = sorted((r.doc_id or 0, r.text.lower()) for r in P.near_dedup(spark, docs, "").collect())
    assert got == [(0, rows[0][1]), (7, rows[2][1]), (7, rows[0][1])]
    assert P.near_dedup(spark, docs.limit(0), "").count() == 0
