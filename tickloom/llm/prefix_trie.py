"""Prefix trie of conversations, evaluated by an Euler tour.

A node is a distinct sequence of first turns, found by a running sum of digests of (place, turn) along each conversation: 120
bits, so a running aggregate in pieces finds the prefixes of a conversation of any length, and the sum without the last digest
names the parent. (Smallest member, depth) orders the nodes: a conversation's own tail has consecutive numbers.

Every node gives an arc that enters it and one that leaves it. `enter` leads to the first child or to the own `leave`, `leave` to the
next sibling's `enter` or to the parent's `leave`. The tour is ranked by contraction (`list_ranks`): blocks of arcs, by number, link
their arcs to chains, a chain counts as one arc in the next, much smaller round, until one block is left; the places are handed
down again. Where a round hardly shrinks the list, arcs are paired by coins instead, which always takes about a quarter away. Sums over a
subtree are then differences of two prefix sums, at the places of its two arcs; they are made in pieces of the tour.

Siblings, prefixes and ends are numbered or digested by ranges of a full order, so no task holds a hot node's children or members:
a node's ending members become texts of at most `ENDS` ids, which one stream digests in order, since SHA-256 has no other way.

Rows without a conv_id belong to no conversation and are left out. Null roles and texts are empty. Turns are ordered by turn, null
first, those alike by the digest of role and text, so repeated rows are repeated turns. A conversation without turns is a member of the root
alone. An empty table has no node, not even a root. Long texts are digested whole. Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.layout import running
from .manifest import numbered, sql_crc32
from .store import written

BLOCK = 1 << 16  # arcs in a task
ENDS = 512
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest and words of every turn."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"))
    return numbered(t, "conv_id", ["turn", "digest", "tie"]).select("conv_id", "pos", "digest", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (c, d from 1, digest, words, ends) of the conversations after the first h = crc32(c) % most turns of each were replaced by those of
    conversation c - c % group; and the conversations themselves (c, total)."""
    turns = written(turns, "turns")
    h = F.crc32(F.col("c").cast("string")) % most
    n = turns.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).withColumns({"b": F.col("c") - F.col("c") % group, "h": h})
    base = n.where(F.col("c") % group == 0).select(F.col("c").alias("b"), F.col("n").alias("n_base"))
    k = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = n.join(base, "b", "left").select("c", "b", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    convs = written(convs, "conversations")
    lead = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "b")
    first = convs.join(lead, "b").where("pos < k").select("c", (F.col("pos") + 1).alias("d"), "digest", "words", "total")
    own = turns.withColumnRenamed("conv_id", "c").where(F.col("pos") >= h).join(convs, "c")
    rest = own.select("c", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("d"), "digest", "words", "total")
    return first.union(rest).withColumn("ends", F.col("d") == F.col("total")).drop("total"), convs.select("c", "total")


def prefixes(rows: DataFrame) -> DataFrame:
    """rows (c, d, digest, ...) with the key of the prefix that they end (x, y) and of the one before it (px, py)."""
    own = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), "digest"), 256)
    part = lambda at: F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(20,0)")
    r = written(rows.withColumns({"u": part(1), "v": part(16)}).drop("digest"), "rebuilt")
    r = running(r, {"su": ("sum", F.col("u")), "sv": ("sum", F.col("v"))}, keys=("c",), order=("d",))
    text = lambda x: x.cast("decimal(38,0)").cast("string")
    key = lambda seed, d, a, b: F.xxhash64(F.lit(seed), d, text(a), text(b))
    here, before = (F.col("d").cast("long"), F.col("su"), F.col("sv")), ((F.col("d") - 1).cast("long"), F.col("su") - F.col("u"), F.col("sv") - F.col("v"))
    return r.withColumns({"x": key(1, *here), "y": key(2, *here), "px": key(1, *before), "py": key(2, *before)}).drop("u", "v", "su", "sv")


def _contract(p: pd.DataFrame) -> pd.DataFrame:
    """Chains inside a block: id, head and offset of every arc; on a chain's last arc also where it leads and the chain's length."""
    p = p.sort_values("id").reset_index(drop=True)
    ids, nxt, size = p["id"].to_numpy(np.int64), p["next"].to_numpy(np.int64), p["size"].to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, nxt), len(ids) - 1)
    inside = ids[at] == nxt
    before = np.arange(len(ids))  # the head points to itself
    before[at[inside]] = np.flatnonzero(inside)
    off = np.where(before == np.arange(len(ids)), 0, size[before])
    while True:
        up = before[before]
        if (up == before).all():
            break
        off = off + off[before]
        before = up
    last = ~inside
    return pd.DataFrame({"id": ids, "head": ids[before], "off": off, "next": np.where(last, nxt, 0), "size": np.where(last, off + size, 0), "last": last})


def list_ranks(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """id and place (from 0) of the arcs of one list; arcs are (id, next), the last one leads to -1."""
    schema = "id long, head long, off long, next long, size long, last boolean"
    link, rounds = arcs.select("id", "next", F.lit(1).cast("long").alias("size")), []
    n, coins = None, False
    while True:
        link = written(link, "arcs")
        before, n = n, link.count()
        coins = before is not None and 4 * n > 3 * before and not coins
        if n > block and coins:
            heads = F.pmod(F.xxhash64("id", F.lit(len(rounds))), F.lit(2)) == 1
            a, b = link.where(heads), link.where(~heads).select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("size").alias("more"))
            pair = written(a.join(b, "next", "left"), "pairs")
            took = pair.where("after IS NOT NULL").select(F.col("next").alias("id"), F.col("id").alias("head"), F.col("size").alias("off"))
            rounds.append(took.union(link.join(took, "id", "left_anti").select("id", F.col("id").alias("head"), F.lit(0).cast("long"))))
            link = pair.select("id", F.coalesce("after", "next").alias("next"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
            link = link.union(written(b.select(F.col("next").alias("id"), F.col("after").alias("next"), F.col("more").alias("size")), "rest").join(took.select("id"), "id", "left_anti"))
            continue
        one = n <= block
        spread = link.withColumn("block", F.lit(0)) if one else numbered(link.withColumn("all", F.lit(0)), "all", ["id"]).withColumn("block", F.floor(F.col("pos") / block))
        done = written(spread.groupBy("block").applyInPandas(_contract, schema), "chains")
        rounds.append(done.select("id", "head", "off"))
        if one:
            break
        link = done.where("last").select(F.col("head").alias("id"), "next", "size")
    place = rounds.pop().select("id", F.col("off").alias("place"))  # one chain is left
    for members in reversed(rounds):
        place = members.join(place.select(F.col("id").alias("head"), "place"), "head").select("id", (F.col("place") + F.col("off")).alias("place"))
    return place


def tour_of(nodes: DataFrame, kids: DataFrame) -> DataFrame:
    """The arcs (id, next) of nodes (id, parent) whose children are numbered in kids (parent, id, pos): 2 * id enters, 2 * id + 1 leaves."""
    first = kids.where("pos = 0").select(F.col("parent").alias("id"), F.col("id").alias("first"))
    after = kids.select("parent", (F.col("pos") - 1).alias("pos"), F.col("id").alias("sibling"))
    sibling = kids.join(after, ["parent", "pos"]).select("id", "sibling")
    n = nodes.select("id", "parent").join(first, "id", "left").join(sibling, "id", "left")
    enter = F.struct((2 * F.col("id")).alias("id"), F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("next"))
    leave = F.struct((2 * F.col("id") + 1).alias("id"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1, F.lit(-1)).alias("next"))
    return n.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*")


def end_digests(ends: DataFrame) -> DataFrame:
    """x, y and the SHA-256 of the ids c of each key, ascending and joined by commas."""
    def texts(batches):
        for p in batches:
            x, y, c = (p[n].to_numpy() for n in "xyc")
            cut = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for i, j in itertools.pairwise([0, *cut.tolist(), len(p)]):
                for s in range(i, j, ENDS):
                    t = min(s + ENDS, j)
                    yield pd.DataFrame({"x": x[s:s + 1], "y": y[s:s + 1], "first": c[s:s + 1], "text": ",".join(map(str, c[s:t].tolist()))})

    def packed(batches):
        some, n = [], 0
        for p in batches:
            some.append(p)
            n += 1
            if n == 4096:
                yield pd.concat(some)
                some, n = [], 0
        if some:
            yield pd.concat(some)

    def digests(batches):
        key, digest, out = None, None, []
        for p in batches:
            for x, y, text in zip(p["x"].tolist(), p["y"].tolist(), p["text"].tolist()):
                if (x, y) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (x, y), hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if out:
                yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
                out = []
        if key is not None:
            yield pd.DataFrame([(*key, digest.hexdigest())], columns=["x", "y", "ends_sha256"])

    order = ["x", "y"]
    parts = ends.select(*order, "c").repartitionByRange(*order, "c").sortWithinPartitions(*order, "c").mapInPandas(lambda b: packed(texts(b)), "x long, y long, first long, text string")
    parts = written(parts, "ends")
    return parts.repartition(*order).sortWithinPartitions(*order, "first").select(*order, "text").mapInPandas(digests, "x long, y long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie over conversations (c, total turns) with turns (c, d, digest, words, ends)."""
    r = written(prefixes(rows), "prefixes")
    zero = [F.xxhash64(F.lit(s), F.lit(0).cast("long"), F.lit("0"), F.lit("0")) for s in (1, 2)]
    inner = r.groupBy("x", "y").agg(F.min("px").alias("px"), F.min("py").alias("py"), F.min("d").cast("long").alias("depth"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    none = F.lit(None).cast("long")
    top = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(zero[0].alias("x"), zero[1].alias("y"), none.alias("px"), none.alias("py"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = numbered(inner.union(top).withColumn("all", F.lit(0)), "all", ["conv_id", "depth"], out="id").drop("all")
    nodes = written(nodes, "nodes")
    # The root is number 0. It has most children, so they get it without a join.
    least = nodes.where("id = 0").select("conv_id").first()
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    low = nodes.where("depth <= 1").withColumns({"parent": F.when(F.col("depth") == 1, F.lit(0).cast("long")), "parent_conv_id": F.when(F.col("depth") == 1, F.lit(least[0] if least else None).cast("long"))})
    nodes = written(low.unionByName(nodes.where("depth > 1").join(above, ["px", "py"])), "parents")
    kids = written(numbered(nodes.where("parent IS NOT NULL").select("parent", "id"), "parent", ["id"]), "kids")
    n_children = kids.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(n_children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    place = list_ranks(tour_of(nodes, kids), block)
    weight = nodes.select((2 * F.col("id")).alias("id"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    arcs = written(place.join(weight, "id", "left").withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("leaf", "saved")}), "tour")
    sums = running(arcs, {"s_leaf": ("sum", F.col("leaf")), "s_saved": ("sum", F.col("saved"))}, keys=(), order=("place",))
    leaves = F.col("id") % 2 == 1
    inside = lambda n: F.sum(F.when(leaves, F.col(f"s_{n}")).otherwise(F.col(n) - F.col(f"s_{n}")))
    sums = sums.groupBy(F.shiftright("id", 1).alias("id")).agg(inside("leaf").alias("n_leaves"), inside("saved").alias("saved_tokens"))

    ends = r.where("ends").select("x", "y", "c").union(convs.where("total = 0").select(*zero, "c"))
    done = nodes.join(sums, "id").join(end_digests(ends), ["x", "y"], "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11(spark, sf_dir: str, block: int = BLOCK) -> DataFrame:
    return trie(*rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), block)


OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS b, {sql_crc32("conv_id")} % 4 AS h FROM t GROUP BY 1),
r0 AS (SELECT c, 0 AS part, pos, role, text FROM n JOIN t ON t.conv_id = n.b AND pos < h UNION ALL SELECT c, 1, pos, role, text FROM n JOIN t ON t.conv_id = n.c AND pos >= h),
r AS (SELECT c, struct_pack(role := role, text := text) AS x, text, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, count(*) OVER (PARTITION BY c) AS total FROM r0),
p AS (SELECT c, d, total, list(x) OVER (PARTITION BY c ORDER BY d) AS pre, len(regexp_extract_all(text, '{WORD}')) AS words FROM r
  UNION ALL SELECT n.c, 0, coalesce((SELECT max(total) FROM r WHERE r.c = n.c), 0), [], 0 FROM n),
nodes AS (SELECT pre, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(words) AS words, coalesce(string_agg(c, ',' ORDER BY c) FILTER (d = total), '') AS ends FROM p GROUP BY pre),
kids AS (SELECT pre[:-2] AS pre, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, up.conv_id AS parent_conv_id FROM nodes LEFT JOIN kids ON kids.pre = nodes.pre LEFT JOIN nodes up ON nodes.depth > 0 AND up.pre = nodes.pre[:-2]),
subs AS (SELECT p.pre, sum((f.n_children = 0)::int) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens FROM full_ f JOIN p ON p.c = f.conv_id AND p.d <= f.depth GROUP BY p.pre)
SELECT conv_id, depth::bigint AS depth, parent_conv_id, n_convs::bigint AS n_convs, n_children::bigint AS n_children, n_leaves::bigint AS n_leaves, saved_tokens::bigint AS saved_tokens, sha256(ends) AS ends_sha256 FROM full_ JOIN subs ON subs.pre = full_.pre
"""
