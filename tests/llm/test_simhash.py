import random
import re

import numpy as np
import xxhash

from quarry.llm.simhash import anchors_of, fingerprints_of, links, near_duplicates, op3_simhash, tables_of
from quarry.operators.components import connected_components


def mixed(h, table):
    if table:
        h = (h + table * 0x9E3779B97F4A7C15) % 2**64
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        h ^= h >> 31
    return h


def plain(text, size=3, table=0):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [mixed(xxhash.xxh64_intdigest(s.encode(), seed=42), table) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """id -> smallest id reachable, by brute force; a list of fingerprints links where any of them does."""
    fps = {k: v if isinstance(v, list) else [v] for k, v in fps.items()}
    label = {k: k for k in fps}
    keys = list(fps)
    changed = True
    near = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if any((x ^ y).bit_count() <= 3 for x, y in zip(fps[a], fps[b], strict=True))]
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_fingerprints():
    rng = random.Random(5)
    texts = ["", " \n", "One", "one TWO", "É a\x0bb\x1cc d", "a b c", "x " * 2000]
    texts += [" ".join(rng.choices("ab Cd é ÀX\t".split(" "), k=rng.randint(1, 900))) for _ in range(60)]
    assert fingerprints_of(texts).tolist() == [plain(t) for t in texts]
    assert tables_of(texts, 5, 3).tolist() == [[plain(t, 5, k) for k in range(3)] for t in texts]
    assert fingerprints_of(["", ""]).tolist() == [0, 0] and len(fingerprints_of([])) == 0


def test_anchors_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, 3000, dtype=np.uint32)
    ax, _ = anchors_of(x)
    assert (np.bitwise_count(ax[:, 0] ^ x) <= 1).all()
    for bit in range(32):
        ay, there = anchors_of(x ^ np.uint32(1 << bit))
        assert ((ay == ax[:, :1]) & there).any(axis=1).all()
    assert (np.bitwise_count(ax ^ x[:, None]) <= 2).all()


def test_links_lose_nothing(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = {i: x for i, x in enumerate(dict.fromkeys(fps))}
    df = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in fps.items()], "node long, fp long")
    want = components(fps)
    for most in (1024, 4):
        got = {r.node: r.component for r in connected_components(links(df, most)).collect()}
        assert {k: got.get(k, k) for k in fps} == want


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_simhash(spark, sf).collect()
    want = {k: plain(t) for k, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in want.items()}
    assert {r.doc_id: r.component_id for r in got} == components(want)


def test_odd_rows(spark):
    rows = [(4, None, 1), (2, "", 1), (None, "a b c d", 2), (7, "a b c d", 2), (7, "a b c d", 2), (9, "A B  c d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(0, None), (2, 2), (4, 2), (7, 7), (7, 7), (9, 7)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_texts_of_one_id_stay_apart(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    a, b = [" ".join(word() for _ in range(300)) for _ in range(2)]
    near = [t + " " + t.split()[0] for t in (a, b)]
    rows = [(5, a), (5, b), (2, near[0]), (3, near[1])]
    assert all((plain(x) ^ plain(y)).bit_count() <= 3 for x, y in zip((a, b), near, strict=True)) and (plain(a) ^ plain(b)).bit_count() > 3
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fp = {plain(t): i for t, i in ((a, 2), (near[0], 2), (b, 3), (near[1], 3))}
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (3, 3), (5, 2), (5, 3)]
    assert all(fp[r.fp % 2**64] == r.component_id for r in got)
