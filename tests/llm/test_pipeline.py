import re

import corpus_pipeline as P
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_nearcopies import brute as brute_near
from tests.llm.test_packing import check as check_packing


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    texts = [{r.doc_id: r.text for r in d.collect()} for d in out[:5]]
    assert all(d.columns == docs.columns for d in out[:5])
    assert texts[1] == {k: t for k, t in texts[0].items() if any(c.isalpha() for c in t)}
    assert texts[2] == brute_lines(texts[1])
    order = sorted(texts[2])
    least = brute_near([texts[2][k] for k in order])
    assert texts[3] == {k: texts[2][k] for i, k in enumerate(order) if least[i] == i}
    secret = r'(?i)(token = ")[0-9a-f]{40}(")|(password=)[0-9a-f]{18}()|()\bAKIA[A-Z0-9]{16}\b()'
    masked = lambda m: "".join(g or "" for g in m.groups()[::2]) + "[SECRET]" + "".join(g or "" for g in m.groups()[1::2])
    assert texts[4] == {k: re.sub(secret, masked, t) for k, t in texts[3].items()}
    used, least = check_packing(out[4].collect(), out[5].collect(), 2048)
    assert used <= 1.02 * least
    assert all(r.n_chars == len(r.text) for r in out[4].collect())
    rows = P.run(spark, sf)
    key = lambda d: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert key(rows) == key(out[5])


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a\nb\nc", None, None, None), (3, "a\nb\nc", "en", "s", 5), (3, "a\nb\nc", "en", "s", 5), (4, "x y z w", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        d = start
        for name, stage in P.STAGES:
            d = stage(spark, d, "")
            n = d.count()
            if name == "near_dedup" and start is docs:
                assert sorted((r.doc_id or 0) for r in d.collect()) == [0, 3, 4]
    assert n == 0
