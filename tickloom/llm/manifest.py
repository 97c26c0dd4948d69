"""Merkle manifest of a dataset with a witness for every row, by incremental witnesses.

A row's leaf is a digest of its fields. Leaves of one group (`lang` in op13) are appended in the order of the rows to a tree:
subtrees of full height wait open until their right sibling is complete, and each completion hands the other side's digest to
the leaves of both (`append`). So a leaf's witness starts as a partial one inside its open subtree and is only ever extended.

Distributed, aligned blocks of 2**HEIGHT leaves are appended by one task each and give partial witnesses and a block root. The
block roots are the leaves of the next, 2**HEIGHT times smaller table, until one is left of each group; these subroots are
appended to the tree over all groups. On the way back the witness of a block extends those of its members, by equi joins in
which a key has at most 2**HEIGHT rows. No task ever holds more than a block, whatever the skew of the groups.

A run of two nodes becomes H(left + right) and a lone last node H(node), as long as a level has more than one node; H is the
lowercase hex SHA-256 of its inputs concatenated, digests as hex text. A witness is a text of steps from leaf to root: `L` or
`R` and the digest of the sibling on that side, `-` where there is none.

Null fields count as `-`, empty texts as `0:`; long texts are read as a whole, once. Rows without an id come first in their
group, rows without a group are a group of their own, which comes first. Rows with one id are ordered by their leaf; rows
alike in all fields have one leaf each, and which of them has which place can't be told apart. An empty table has an empty
manifest. Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: Sequence[Column]) -> Column:
    """Digest of the fields: each `-` if null, else its UTF-8 byte count, a colon and its value."""
    value = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in value]), 256)


def append(digests: list[str], height: int | None) -> tuple[list[str], str]:
    """The witnesses and the root of leaves appended one after another, at `height` levels; None: as many as one root needs."""
    witness: list[list[str]] = [[] for _ in digests]
    open_: list[tuple[int, str, range]] = []  # level, digest and leaves of the subtrees that wait for their right sibling

    def settle(node):
        """Closes the open subtree of the same level, if there is one, and so on upwards."""
        while open_ and open_[-1][0] == node[0]:
            level, left, mine = open_.pop()
            for i in mine:
                witness[i].append("R" + node[1])
            for i in node[2]:
                witness[i].append("L" + left)
            node = (level + 1, hashed(left, node[1]), range(mine.start, node[2].stop))
        open_.append(node)

    for i, d in enumerate(digests):
        settle((0, d, range(i, i + 1)))
    while len(open_) > 1 or (height is not None and open_[0][0] < height):
        level, last, mine = open_.pop()  # nothing will come to its right
        for i in mine:
            witness[i].append("-")
        settle((level + 1, hashed(last), mine))
    return ["".join(w) for w in witness], open_[0][1]


def numbered(rows: DataFrame, key: str, order: Sequence[str], out: str = "pos") -> DataFrame:
    """rows with their exact place, from 0, in their key; the pieces of a key follow Spark's ranges over the full order."""
    spark = rows.sparkSession
    cut = written(rows.repartitionByRange(key, *order).withColumn("piece", F.spark_partition_id()), "pieces")
    sizes = cut.groupBy("piece", key).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("piece", key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("piece", key).orderBy(*order)) - 1
    done = cut.withColumn("_inside", inside).join(starts, ["piece", key])
    return done.withColumn(out, F.col("start") + F.col("_inside")).drop("piece", "start", "_inside")


def partial_witnesses(nodes: DataFrame, height: int) -> DataFrame:
    """key, pos, digest, witness inside the block, top (the block's root, on its first row only)."""
    def block(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos", kind="stable").reset_index(drop=True)
        # A block that isn't full is the last of its key; if it is also the first, the tree ends with its root.
        witness, root = append(p["digest"].tolist(), None if p["pos"].iloc[0] == 0 else height)
        top = [root] + [None] * (len(p) - 1)
        return pd.DataFrame({"key": p["key"], "pos": p["pos"], "digest": p["digest"], "extra": p["extra"], "witness": witness, "top": top})

    n = nodes.select("key", "pos", "digest", "extra").withColumn("_block", F.shiftright("pos", height))
    done = n.groupBy("key", "_block").applyInPandas(lambda k, p: block(p), "key string, pos long, digest string, extra struct<id:long,forged:string>, witness string, top string")
    return written(done, "witnesses")


def _grown(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Partial witnesses of the nodes, of their block roots, and so on until every key has one block."""
    levels = [partial_witnesses(nodes, height)]
    while not levels[-1].where(F.col("pos") >= (1 << height)).isEmpty():
        levels.append(partial_witnesses(_roots(levels[-1], height), height))
    return levels


def witnesses(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Nodes (key, pos gapless from 0 in each key, digest, extra) with their witness up to the root of their key's tree, and that
    root as `subroot`; then on through the tree over the subroots in the order of the keys, whose root is `root`."""
    levels = _grown(nodes, height)
    tops = _roots(levels[-1], height).select("key", F.col("digest").alias("subroot"))
    # The tree over all groups: the same work on one key.
    groups = numbered(tops.select(F.lit("").alias("all"), "key", "subroot"), "all", ["key"])
    tree = _grown(groups.select(F.lit("").alias("key"), "pos", F.col("subroot").alias("digest"), _no_extra()), height)
    last = _roots(tree[-1], height).select("key", F.lit(0).cast("long").alias("block"), F.lit("").alias("above"), F.col("digest").alias("root"))
    last = _down(tree, last, height, ["root"])
    names = groups.select(F.col("key").alias("group"), "pos", "subroot")
    up = last.select("pos", "root", F.col("witness").alias("above")).join(names, "pos")
    return _down(levels, up.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("block"), "above", "subroot", "root"), height, ["subroot", "root"])


def _no_extra() -> Column:
    return F.lit(None).cast("struct<id:long,forged:string>").alias("extra")


def _roots(level: DataFrame, height: int) -> DataFrame:
    """The block roots of a level as nodes of the next one."""
    return level.where("top IS NOT NULL").select("key", F.shiftright("pos", height).alias("pos"), F.col("top").alias("digest"), _no_extra())


def _down(levels: list[DataFrame], blocks: DataFrame, height: int, carry: list[str]) -> DataFrame:
    """The lowest level's witnesses, extended level by level by those of the blocks above."""
    for level in reversed(levels):
        j = level.withColumn("block", F.shiftright("pos", height)).join(blocks, ["key", "block"])
        done = j.select("key", "pos", "digest", "extra", F.concat("witness", "above").alias("witness"), *carry)
        blocks = done.select("key", F.col("pos").alias("block"), F.col("witness").alias("above"), *carry)
    return done


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf gives with the siblings of a witness."""
    steps = F.regexp_extract_all(witness, F.lit("-|[LR][0-9a-f]+"), F.lit(0))

    def up(node, step):
        side, other = F.left(step, F.lit(1)), F.substring(step, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(other, node)).when(side == "R", F.concat(node, other)).otherwise(node), 256)
    return F.aggregate(steps, leaf, up)


def siblings_digest(witness: Column) -> Column:
    """H of all siblings of a witness, from leaf to root."""
    return F.sha2(F.translate(witness, "LR-", ""), 256)


def manifest(docs: DataFrame, forged: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, witness of each row, and the leaf that it would have with n_chars as in `forged`."""
    at = FIELDS.index("n_chars")
    fields = [F.col(n) for n in FIELDS]
    other = fields[:at] + [fields[at] if forged is None else forged] + fields[at + 1:]
    leaf = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("key"), leaf_of(fields).alias("digest"),
                       F.when(~other[at].eqNullSafe(fields[at]), leaf_of(other)).alias("forged"))
    rows = numbered(leaf.withColumn("tie", F.monotonically_increasing_id()), "key", ["doc_id", "digest", "tie"])
    w = witnesses(rows.select("key", "pos", "digest", F.struct(F.col("doc_id").cast("long").alias("id"), "forged").alias("extra")), height)
    return w.select(F.col("extra.id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "witness", F.coalesce("extra.forged", "digest").alias("forged"))


def op13(spark, sf_dir: str, height: int = HEIGHT) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    m = manifest(docs, F.col("n_chars") + F.when(hit, 1).otherwise(0), height).withColumn("folded_root", folded(F.col("forged"), F.col("witness")))
    return m.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("witness")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(x: str) -> str:
    return f"coalesce(strlen(cast({x} AS varchar)) || ':' || cast({x} AS varchar), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


def sql_crc32(x: str) -> str:
    """Unsigned CRC-32 of the decimal text of x: eight shifts for each character."""
    shifts = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast({x} AS varchar), ''), lambda ch: ord(ch)::bigint)), lambda a, b: {shifts}), 4294967295::bigint)"


OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {sql_crc32("doc_id")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS forged FROM documents),
l AS (SELECT *, coalesce('=' || lang, '') AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT k, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY k) AS n FROM l
  UNION ALL SELECT k, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY k, lvl, pos // 2),
g AS (SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM g
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
steps AS (
  SELECT l.k, l.pos, t.lvl AS no, (l.pos >> t.lvl) & 1 AS side, s.h FROM l JOIN (SELECT DISTINCT k, lvl FROM t WHERE n > 1) t ON t.k = l.k LEFT JOIN t s ON s.k = l.k AND s.lvl = t.lvl AND s.pos = xor(l.pos >> t.lvl, 1)
  UNION ALL SELECT l.k, l.pos, 1000 + u.lvl, (g.pos >> u.lvl) & 1, s.h FROM l JOIN g ON g.k = l.k, (SELECT DISTINCT lvl FROM u WHERE n > 1) u LEFT JOIN u s ON s.lvl = u.lvl AND s.pos = xor(g.pos >> u.lvl, 1)),
w AS (SELECT k, pos, list(struct_pack(side := side, h := coalesce(h, '')) ORDER BY no) AS w FROM steps GROUP BY 1, 2),
f AS (SELECT l.doc_id, l.leaf, g.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(coalesce(list_aggregate(list_transform(w, lambda x: x.h), 'string_agg', ''), '')) AS proof_sha256,
  CASE WHEN w IS NULL THEN forged ELSE list_reduce(list_prepend(struct_pack(side := 0::bigint, h := forged), w), lambda a, x: struct_pack(side := 0::bigint, h := sha256(CASE WHEN x.side = 1 THEN x.h || a.h ELSE a.h || x.h END))).h END AS folded_root
  FROM l JOIN g ON g.k = l.k LEFT JOIN w ON w.k = l.k AND w.pos = l.pos)
SELECT *, folded_root = root AS verified FROM f
"""
