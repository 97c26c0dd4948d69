"""The prefix trie against brute force, list ranks against a walk."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import prefix_trie as p

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append(((t is not None, t or 0, sha(f"{len(role.encode())}:{role}{text}")[:32]), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in by.items()}
    full = {c: own.get(c - c % 20, [])[:(h := zlib.crc32(str(c).encode()) % 4)] + own[c][h:] for c in own}
    members = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def totals(k):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        below = [totals(x) for x in kids[k]]
        return (sum(b[0] for b in below) or not kids[k]) + 0, sum(b[1] for b in below) + (len(members[k]) - 1) * words
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *totals(k),
                    sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(k)))))) for k, m in members.items()), key=repr)


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["hi", "yes  no", "é\tü", "", "x " * 30, "a b"]
    return [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice([*words, None])) for c in range(n) for t in range(rng.randrange(1, 6))]


HOT = [(c, t, "user", "the same first turn" if t == 0 else f"own {c} {t}") for c in range(45) for t in range(3)] + [(c, t, "u", f"same {t}") for c in range(50, 120) for t in range(4)]
CASES = {
    "random": random_rows(60, 1),
    "hot": HOT,
    "repeated": random_rows(20, 2) * 2,
    "long": [(3, t, "r", f"{t % 3}") for t in range(300)] + [(4, t, "r", f"{t % 3}") for t in range(299)] + [(20, 0, "r", "w " * 200_000)],
    "turnless": [(c, 0, "r", "x") for c in range(1, 60) if c not in (20, 40)],
    "nulls": [(None, 1, "a", "b"), (1, None, None, None), (1, None, None, None), (0, 2, "", ""), (None, None, None, None), (2, 0, None, "a")],
    "one": [(5, 0, "r", "x y")],
}


def result(spark, path, rows, block, more=lambda d: d):
    more(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{path}/conversations.parquet")
    return p.op11(spark, str(path), block)


@pytest.mark.parametrize("name,block", [("random", 16), ("hot", 1000), ("repeated", 1 << 16), ("long", 64), ("turnless", 1 << 16), ("nulls", 4), ("one", 1 << 16)])
def test_brute_force(spark, tmp_path, name, block):
    spark.conf.set("tickloom.chunkRows", "40")
    try:
        got = sorted((tuple(r) for r in result(spark, tmp_path, CASES[name], block).collect()), key=repr)
    finally:
        spark.conf.unset("tickloom.chunkRows")
    assert got == brute(CASES[name])


def test_equals_sql(spark, tmp_path):
    more = lambda d: d.withColumns({n: F.lit(1) for n in ("c", "pos", "digest", "d", "x", "id", "place", "words", "block", "total", "piece")})
    got = result(spark, tmp_path, CASES["random"], 1 << 16, more)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = ", ".join(got.columns)
    assert sorted(map(repr, con.execute(f"SELECT {names} FROM ({p.OP11_SQL})").fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_empty(spark, tmp_path):
    assert result(spark, tmp_path, [], 4).count() == 0


@pytest.mark.parametrize("block,shuffled", [(1000, True), (7, False), (25, True)])
def test_list_ranks(spark, block, shuffled):
    ids = list(range(100, 400))
    if shuffled:
        random.Random(5).shuffle(ids)
    arcs = spark.createDataFrame(list(zip(ids, [*ids[1:], -1])), "id long, next long")
    got = {r["id"]: r["place"] for r in p.list_ranks(arcs, block).collect()}
    assert got == {x: i for i, x in enumerate(ids)}


def test_end_digests_of_a_hot_node(spark):
    ends = spark.range(-700, 5000).select(F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("y"), F.col("id").alias("c"))
    got = p.end_digests(ends.union(spark.createDataFrame([(9, 9, 3)], "x long, y long, c long"))).collect()
    assert {(r["x"], r["y"]): r["ends_sha256"] for r in got} == {(1, 2): sha(",".join(map(str, range(-700, 5000)))), (9, 9): sha("3")}
