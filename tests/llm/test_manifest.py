"""The Merkle manifest against a tree built level by level."""
import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import manifest as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])])


def tree(level):
    """Root, and for each node its steps (side or None, sibling)."""
    steps, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            o = a ^ 1
            steps[i].append(("L" if a & 1 else "R", level[o]) if o < len(level) else (None, ""))
        level = [h(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at = [a // 2 for a in at]
    return level[0], steps


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {k: tree([leaf(r) for r in sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for k in order}
    root, tops = tree([subs[k][0] for k in order])
    out = []
    for k, top in zip(order, tops):
        for r, steps in zip(sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), subs[k][1]):
            steps = steps + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf(r, int(hit))
            for side, s in steps:
                x = h(s, x) if side == "L" else h(x, s)
            out.append((r[0], leaf(r), subs[k][0], root, h(*[s for _, s in steps]), x, x == root))
    return sorted(out, key=repr)


ROWS = [(i, f"text {i} é" * (i % 5), ["en", "de", None, "fr", ""][i % 5 if i % 3 else 0], "web" if i % 4 else None, None if i % 6 == 0 else i) for i in range(61)]
CASES = {
    "many": ROWS,
    "one": ROWS[:1],
    "lone leaves": [(1, "a", "en", "s", 1), (2, "b", "de", "s", 1), (3, None, None, None, None)],
    "ties": [(7, "x", "en", "s", 3), (7, "y", "en", "s", 3), (7, "x", "en", "s", 3), (None, "x", "en", "s", 3), (None, None, None, None, None), (None, "", "", "", 0)],
    "long": [(i, "long é " * 300_000 if i == 2 else "s", "en", "s", 9) for i in range(5)],
}


def result(spark, path, rows, height, extra=None):
    d = spark.createDataFrame(rows, SCHEMA)
    (d if extra is None else extra(d)).write.parquet(f"{path}/documents.parquet")
    return m.op13(spark, str(path), height)


@pytest.mark.parametrize("name,height", [("many", 1), ("many", 2), ("many", 12), ("one", 2), ("lone leaves", 1), ("ties", 1), ("ties", 3), ("long", 2)])
def test_brute_force(spark, tmp_path, name, height):
    got = result(spark, tmp_path, CASES[name], height).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(CASES[name])


def test_tampering_shows(spark, tmp_path):
    got = result(spark, tmp_path, ROWS, 3).toPandas()
    hit = {r[0] for r in ROWS if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}
    assert hit and set(got[~got["verified"]]["doc_id"]) == hit


def test_empty_and_clashing_columns(spark, tmp_path):
    assert result(spark, tmp_path / "a", [], 2).count() == 0
    more = lambda d: d.withColumns({n: F.lit(1) for n in ("key", "pos", "piece", "digest", "witness", "top", "block", "root", "subroot", "leaf", "extra", "n", "tie", "_block")})
    assert sorted((tuple(r) for r in result(spark, tmp_path / "b", ROWS, 2, more).collect()), key=repr) == brute(ROWS)
    assert result(spark, tmp_path / "b2", ROWS, 2).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_append_extends_only():
    digests = [h(str(i)) for i in range(13)]
    for n in range(1, 13):
        before, _ = m.append(digests[:n], None)
        after, root = m.append(digests, None)
        full = n.bit_length() - 1  # levels that are complete for the first 2**full leaves
        assert all(a[:65 * full] == b[:65 * full] for a, b in zip(after[:1 << full], before[:1 << full]))
        assert root == tree(digests)[0]
