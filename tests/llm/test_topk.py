import numpy as np

from tickloom.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score long"


def brute(rows, queries, k):
    at = lambda e: [int(np.floor(256.0 * float(np.float32(x)))) for x in e]
    out = {}
    for q in queries:
        s = sorted((-sum(a * b for a, b in zip(at(rows[q]), at(e))), i) for i, e in rows.items() if i != q and len(e) == len(rows[q]))
        out[q] = [(n + 1, i, -x) for n, (x, i) in enumerate(s[:k])]
    return out


def run(spark, rows, queries, k=5, **sizes):
    df = spark.createDataFrame([(i, e, 0, 9, 9) for i, e in rows], SCHEMA)
    got = {}
    for r in top_k(df, df.where(df.vec_id.isin(queries)), k, **sizes).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def test_against_brute_force(spark):
    g = np.random.default_rng(4)
    rows = {i: g.normal(size=6).astype("float32").tolist() for i in range(400)}
    rows |= {400 + i: rows[i % 3] for i in range(60)} | {500: [0.0] * 6, 501: [1e-3, -1e-3, 0.0, 0.0, 0.0, 0.0], 502: [2.0, 1.0], 503: [-1.0, 5.0]}
    queries = [0, 1, 50, 401, 500, 501, 502]
    assert run(spark, rows.items(), queries, n_vectors=64, n_queries=3) == brute(rows, queries, 5)


def test_unusable_repeated_and_few_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [None, 1.0]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, []), (None, [1.0, 1.0])]
    assert run(spark, rows, [1, 3, 4, 5, 6, 7]) == {1: [(1, 2, 128 * 256)]}
    assert run(spark, [], [1]) == {}


def test_large_components_stay_exact(spark):
    rows = {1: [3e6, 1.0], 2: [3e6, 1.0], 3: [3e6, 1.0 + 2 ** -8], 4: [-3e6, 0.0]}
    assert run(spark, rows.items(), [1]) == brute(rows, [1], 5)
