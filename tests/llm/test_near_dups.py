import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import near_dups
from tickloom.llm.components import components, roots
from tickloom.llm.near_dups import near_copies, without_near_copies
from tickloom.llm.shingles import shingle_sets
from tickloom.llm.superminhash import signatures


def reference_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))


def brute(rows):
    """rows: (doc_id, text) with doc_ids; rows of one doc_id are one document."""
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, reference_set(t)) for i, t in rows]
    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            common = len(s & t)
            if s and t and 100 * common >= 75 * (len(s) + len(t) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def corpus(r):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(r.choice([3, 8, 40, 120]))] for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            k = r.randrange(max(1, len(w)))
            w[k:k + 1] = r.choice([[word()], [], [*w[k:k + 1], word()]])
        rows.append((i, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows + [(300, None), (301, ""), (302, " \n "), (303, "A b"), (304, "a B"), (305, "a")]


def result(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, component_id string")
    return near_copies(df).collect()


@pytest.mark.parametrize("part, large", [(1024, 1 << 14), (3, 5)])
def test_against_brute_force(spark, part, large, monkeypatch):
    monkeypatch.setattr(near_dups, "PART", part)  # small numbers: buckets count as large, and are cut further and into blocks
    monkeypatch.setattr(near_dups, "LARGE", large)
    rows = corpus(random.Random(8))
    got, want = result(spark, rows), brute(rows)
    assert len(got) == len(rows)
    for x in got:
        assert (x.component_id, x.kept) == (want[x.doc_id], want[x.doc_id] == x.doc_id)
        assert x.n_shingles == len(reference_set(dict(rows)[x.doc_id]))


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    """Few and short bands, so that most pairs share no second one: a bucket counts as large or not, the result is the same."""
    df = spark.createDataFrame(corpus(random.Random(5)), "doc_id long, text string")
    got = []
    for large in (1 << 14, 2):
        monkeypatch.setattr(near_dups, "LARGE", large)
        got.append({x.doc_id: x.component_id for x in near_copies(df, places=4, rows=2).collect()})
    assert got[0] == got[1]


def test_chain_through_a_passage(spark):
    r = random.Random(4)
    long = [f"w{k}" for k in range(100)]
    # Each document is near its neighbours in the chain only.
    rows = [(500 - i, " ".join(long[i * 3:] + [f"x{i}" for i in range(i * 3)])) for i in range(20)]
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + i, shared + " " + " ".join(f"{r.random()}" for _ in range(60))) for i in range(150)]
    want = brute(rows)
    assert {x.doc_id: x.component_id for x in result(spark, rows)} == want


def test_repeated_rows_ids_and_no_rows(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(5, a), (5, a), (5, b), (7, b), (6, a), (None, a), (None, None), (9, None)]
    got = Counter((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in result(spark, rows))
    assert got == Counter([(5, 3, 5, True)] * 3 + [(7, 3, 5, False), (6, 3, 5, False), (None, 3, None, True), (None, 0, None, True), (9, 0, 9, True)])
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    assert sorted(str(x.doc_id) for x in without_near_copies(df).collect()) == ["5", "5", "5", "9", "None", "None"]
    assert near_copies(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    g, err = np.random.default_rng(0), []
    for _ in range(200):
        u = g.integers(0, 2**63, 400, dtype=np.uint64)
        s = signatures([u[:320], u[80:]], 128)
        err.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 0.043  # independent functions: 0.0433
    assert (signatures([u, u[::-1].copy()], 64)[0] == signatures([u], 64)[0]).all()


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, x) for x in range(1001, 1500)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(7, 7)]
    node, root = roots(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    want = {int(n): int(c) for n, c in zip(node, root) if c < n}
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == want and want[300] == 0 and want[1499] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets():
    ts = [t for _, t in corpus(random.Random(1))]
    assert [len(s) for s in shingle_sets([t or "" for t in ts])] == [len(reference_set(t)) for t in ts]


def test_join_for_texts_moves_few_others(spark):
    docs = spark.range(20_000).selectExpr("if(id = 3, null, id) AS doc_id", "cast(id AS string) AS text")
    ids = spark.createDataFrame([(7,), (7,), (15_000,)], "doc_id long")
    for marks, most in ((near_dups.MARKS, 20), (64, 20_000)):  # with few marks many documents share one, but none is lost
        got = near_dups._marked(docs, ids, marks)
        assert got.columns == docs.columns
        got = [r.doc_id for r in got.collect()]
        assert {7, 15_000} <= set(got) and len(set(got)) == len(got) <= most


def test_tables_on_the_way_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "i j k l m n")]
    before = set(os.listdir(folder))
    out = without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["copies"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
