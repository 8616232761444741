import zlib

import numpy as np

from quarry.llm.langid import CHARS, _few, codewords, features, fit, identify, op6_language_id, train


def test_codewords():
    for k in (2, 3, 4, 5, 9, 30):
        c = codewords(k)
        apart = [(c[i] != c[j]).sum() for i in range(k) for j in range(i)]
        assert min(apart) >= (1 if k == 2 else c.shape[1] // 4)
        assert (np.abs(c.sum(axis=0)) < k).all() or k > 5
    assert codewords(1).shape == (1, 0)


def test_a_text_is_seen_alone():
    texts = ["Ab c!", "", "1 2", "élan ÉLAN", "x" * 5000]
    together, letters = features(texts)
    for i, t in enumerate(texts):
        assert (features([t])[0][0] == together[i]).all()
    assert letters.tolist() == [True, False, False, True, True]
    assert (features(["Ab, C"])[0] == features(["aB...c"])[0]).all()


def test_few_characters_are_held_at_a_time():
    import pyarrow as pa

    texts = [*(("ab " * (k * 997)) for k in range(100)), "", None, "é" * (CHARS + 1), None, *("x" for _ in range(450))]
    parts = list(_few(pa.array(texts)))
    assert [t for _, part in parts for t in part] == [t or "" for t in texts]
    assert all(at == sum(len(p) for _, p in parts[:i]) and 0 < len(part) <= 200 for i, (at, part) in enumerate(parts))
    assert all(sum(map(len, part)) <= CHARS for _, part in parts if len(part) > 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_language_id(spark, sf).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)
    assert sum(r.ambiguous for r in got) < 0.02 * len(got)


def test_predictions_against_plain_loops(spark):
    """Every text's n-grams counted one by one, the bits of each codeword weighed one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs)
    got = {r.doc_id: r for r in identify(docs.select("doc_id", "text"), model).collect()}
    two32, bad = 2**32, 0
    for r in docs.collect():
        folded = [ord(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else 32 for c in f" {r.text or ''} "]
        c = [x for i, x in enumerate(folded) if i == 0 or x != 32 or folded[i - 1] != 32]
        bins = np.zeros(2048)
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = c[i] * 2654435761 % two32
                for k, factor in ((1, 2246822519), (2, 3266489917)):
                    if n > k:
                        h = (h * factor + c[i + k] * 668265263) % two32
                        h ^= h >> 15
                bins[(h * 2654435769 % two32 >> 21) % 2048] += 1
        x = np.sqrt(bins / max(1, bins.sum())).astype(np.float32)
        if not any(v != 32 for v in c):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        f = [float(sum(x[i] * model.weights[i, j] for i in np.flatnonzero(x))) + float(model.bias[j]) for j in range(model.codes.shape[1])]
        loss = [sum(model.trust[j] * np.log1p(np.exp(-code[j] * f[j])) for j in range(len(f))) for code in model.codes]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        bad += got[r.doc_id].lang_pred != model.langs[int(np.argmin(loss))]
        assert abs(got[r.doc_id].score - p.max()) < 1e-4
    assert bad == 0


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from quarry.llm.langid import held_out
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang")))
    a, b = train(docs), train(other)
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights)


def test_odd_rows(spark):
    rows = [(1, "der und die", "de", 0.5), (2, None, "de", 1.0), (4, "12 !", None, 1.0), (None, "the and", "en", 1.0), (5, "word " * 50_000, "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    one = train(df)
    got = {r.doc_id: r.lang_pred for r in identify(df, one).collect()}
    assert got[2] == got[4] == "und" and set(one.langs) <= {"de", "en"}
    none = train(df.limit(0))
    assert {r.lang_pred for r in identify(df, none).collect()} == {"und"}
    assert identify(df.limit(0), one).count() == 0
    alone = fit(features(["ab"])[0], ["zz"])
    assert alone.predict(["abc", "1"])[0] == ["zz", "und"]
