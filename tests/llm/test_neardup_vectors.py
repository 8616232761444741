import random

import numpy as np

from quarry.llm.neardup_vectors import class_links, near_duplicate_vectors, op9_vector_neardup


def brute(rows, least=0.98):
    ok = [i for i, (k, v, l) in enumerate(rows) if k is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for x, i in enumerate(ok):
        for j in ok[x + 1 :]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, edge = {i}, [i]
        while edge:
            for j in links[edge.pop()] - seen:
                seen.add(j)
                edge.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids, default=None), bool(ids) and rows[i][0] == min(ids)))
    return sorted(out, key=str)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in op9_vector_neardup(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_small(spark):
    rng = random.Random(9)
    rows, n = [], 0
    for dim in (2, 8, 20):
        for _ in range(12):
            c = [rng.gauss(0, 1) for _ in range(dim)]
            for _ in range(rng.choice([1, 2, 25])):
                s = rng.choice([0, 0.01, 0.06])
                rows.append((n, [x * rng.choice([1.0, 2.0]) + rng.gauss(0, s) for x in c], rng.randint(0, 1)))
                n += 1
    nan = float("nan")
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0, 0.0], 1), (n + 3, [nan, 1.0], 1), (n + 4, [1.0, None], 1), (n + 5, [1.0, 2.0], None), (n + 6, [float("inf"), 1.0], 1)]
    rows += [(None, [1.0, 2.0], 1)]
    # one vec_id, different vectors, each with near ones of its own; and equal rows
    rows += [(1000, [1.0, 0.0], 5), (1000, [0.0, 1.0], 5), (1001, [1.0, 0.01], 5), (1002, [0.01, 1.0], 5), (1003, [0.0, 1.02], 5), (1003, [0.0, 1.02], 5)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    got = sorted((tuple(r) for r in near_duplicate_vectors(df).collect()), key=str)
    assert got == brute(rows)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_parts_do_not_matter(spark):
    rng = random.Random(3)
    rows = [(i, [1.0 + rng.gauss(0, 0.1) for _ in range(16)], 3, rng.randint(1, 4)) for i in range(150)]
    df = spark.createDataFrame(rows, "node long, embedding array<float>, label long, mult long")
    sums = lambda d: sorted(tuple(r) for r in d.where("b is null").groupBy("a").sum("n").collect())
    assert sums(class_links(df, 0.98, most=10)) == sums(class_links(df, 0.98)) and len(sums(class_links(df, 0.98))) > 100
