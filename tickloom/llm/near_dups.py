"""Near copies: SuperMinHash signatures, banding, verification on full sets, and union-find grouping.

Two documents are linked if their sets of 5-word shingles have a Jaccard similarity of 0.75 or more. Documents with equal
sets are one node, so a group of copies is never paired. Nodes that share a band are a bucket. First every member of a
bucket is compared with the smallest one, which is linear and joins a group of near copies at once. Then the members that
are not in the largest component of their bucket are compared with all its members of other components, block by block.
In buckets of more than `LARGE` nodes, the members that share a second band are first joined by their smallest one too, which
leaves fewer members to compare and no pair out: results don't depend on it. No bucket is left out.

Before full sets are compared, a pair must agree in enough of the `FINE` places of longer signatures (one bit each), that nodes
of shared buckets get: `MARGIN` below the wanted similarity, which is five standard deviations. A pair that shares several
buckets is looked at in the first of them. With 32 bands of 4
places a pair at 0.75 shares a band with probability 1 - 5e-6; closer pairs more.

Null and empty texts have empty sets and are linked with nothing. Rows with equal doc_id are one document, linked with
whatever any of its rows is. Rows without a doc_id are linked with nothing and kept. Repeated rows give repeated results.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .components import components
from .pieces import slices
from .shingles import U, mix, shingle_sets
from .store import concluded, text_of, written
from .superminhash import bands, signatures, sketches

WIDTH, PLACES, ROWS, PERCENT = 5, 128, 4, 75
FINE, MARGIN, PART, LARGE = 1024, 0.1, 1024, 1 << 14
MARKS = 1 << 24  # bits of the filter in front of the join that fetches texts


def signed(docs: DataFrame, width: int = WIDTH, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """doc_id, n (set size), d1 and d2 (digest of the set), bands."""
    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in slices(texts, 1 << 20):
                sets = shingle_sets(texts[i:j], width)
                size = np.array([len(s) for s in sets])
                sums = [[int(mix(s + U(k)).sum(dtype=U).view(np.int64)) for s in sets] for k in (1, 2)]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "n": size, "d1": sums[0], "d2": sums[1],
                                    "bands": list(bands(signatures(sets, places), rows))})
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles, sketch of the documents."""
    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            for i, j in slices(texts, 1 << 20):
                sets = shingle_sets(texts[i:j], width)
                yield pd.DataFrame({"node": b["doc_id"].iloc[i:j].array, "shingles": [s.view(np.int64) for s in sets], "sketch": list(sketches(signatures(sets, FINE)))})
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "node long, shingles array<long>, sketch array<long>")


def _marked(docs: DataFrame, ids: DataFrame, marks: int = MARKS) -> DataFrame:
    """The rows of docs whose doc_id is in ids, and a few others: ids set one of `marks` bits each, and that many bits at most are
    broadcast (64 to a row). So the join behind it doesn't move the texts of all documents."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(marks))
    slot, place = (lambda c: F.shiftright(bit(c), 6)), (lambda c: bit(c).bitwiseAND(F.lit(63)).cast("int"))
    words = ids.groupBy(slot("doc_id").alias("__slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place("doc_id"))).alias("__word"))
    met = docs.withColumn("__slot", slot("doc_id")).join(F.broadcast(words), "__slot")
    return met.where(F.call_function("bit_get", "__word", place("doc_id")) == 1).select(docs.columns)


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    both = pairs.join(two, "b").join(one, "a")
    common = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - common
    return both.where(100 * common >= percent * union).select("a", "b").distinct()


def _likely(s, t, percent: int):
    """Whether two sketches agree in so many places that the sets may be similar enough. Places of sets that differ agree every other time."""
    differ = F.bit_count(F.get(s, F.lit(0)).bitwiseXOR(F.get(t, F.lit(0))))
    for i in range(1, FINE // 64):
        differ = differ + F.bit_count(F.get(s, F.lit(i)).bitwiseXOR(F.get(t, F.lit(i))))
    return differ <= int(FINE * (1 - (percent / 100 - MARGIN)) / 2)


def _sizes(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _stars(member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's members with its smallest one, of sizes that can be similar enough."""
    hub = member.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"))
    j = member.join(hub, "bucket").where((F.col("node") != F.col("hub.node")) & _sizes(F.col("n"), F.col("hub.n"), percent))
    return j.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches are close."""
    one, two = (sets.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").where(_likely(F.col("sa"), F.col("sb"), percent)).select("a", "b").distinct()


def _open(member: DataFrame, top: DataFrame) -> DataFrame:
    """Members of buckets with more than one component, with `component`, and `size` and `main` (most frequent component) of the bucket."""
    known = member.join(top, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    known = written(known, "members")
    each = known.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    split = each.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("size")).where("parts > 1")
    # The two members of a bucket of two have met as hub and member.
    split = split.where("size > 2")
    return written(known.join(split.select("bucket", "size", F.col("main.component").alias("main")), "bucket"), "open")


def _across(open_: DataFrame, sets: DataFrame, banded: DataFrame, percent: int) -> DataFrame:
    """Pairs with close sketches in the same bucket and different components.

    Buckets are cut into parts of about `PART` members; the members outside the main component meet every part. A pair that
    isn't close is never put out."""
    cards = written(sets.select("node", "sketch").join(open_.select("node").distinct(), "node").join(banded.select("node", "bands"), "node"), "cards")
    m = open_.join(cards, "node").withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    columns = ("node", "n", "component", "sketch", "bands")
    stray = m.where("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stray = stray.select("bucket", "part", *[F.col(c).alias(f"{c}_a") for c in columns])
    every = m.select(F.col("bucket").alias("bucket_b"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part_b"),
                     (F.col("component") == F.col("main")).alias("main_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    j = stray.join(every, (F.col("bucket") == F.col("bucket_b")) & (F.col("part") == F.col("part_b")) & (F.col("component_a") != F.col("component_b"))
                   & (F.col("main_b") | (F.col("node_a") < F.col("node_b"))) & _sizes(F.col("n_a"), F.col("n_b"), percent) & _likely(F.col("sketch_a"), F.col("sketch_b"), percent)
                   & (F.slice(F.array_sort(F.array_intersect("bands_a", "bands_b")), F.lit(1), F.size("bucket")) == F.col("bucket")))
    return j.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_links(docs: DataFrame, sigs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(node of each distinct set, component of each node that has a smaller one)."""
    key = ["d1", "d2", "n"]
    heads = written(sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("node")), "nodes")
    banded = sigs.join(heads.withColumnRenamed("node", "doc_id"), [*key, "doc_id"], "left_semi").withColumnRenamed("doc_id", "node")
    member = banded.select(F.explode("bands").alias("band"), "node", "n")
    shared = member.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    member = written(member.join(shared, "band", "left_semi").select(F.array("band").alias("bucket"), "node", "n"), "buckets")
    nodes = written(member.select(F.col("node").alias("doc_id")).distinct(), "bucketed")
    sets = written(_sets(_marked(docs.select("doc_id", "text"), nodes).join(nodes, "doc_id", "left_semi"), width), "sets")
    # Rows with one doc_id and different texts are one document.
    same = (sigs.where("doc_id IS NOT NULL").join(heads, key).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
            .where("a <> b").select("a", "b"))
    alike = lambda pairs: written(_alike(written(pairs, "pairs"), sets, percent), "alike")
    links = written(same.union(alike(_promising(_stars(member, percent), sets, percent))), "links")
    top = components(links)
    open_ = _open(member, top)
    large = open_.where(F.col("size") > LARGE)
    if not large.isEmpty():
        # Hubs of finer buckets join most of a large bucket first, so that fewer strays meet all its members. No pair is left out by it.
        finer = large.select("node", "n", "bucket").join(banded.select("node", "bands"), "node")
        finer = finer.select("node", "n", "bucket", F.explode(F.array_except("bands", "bucket")).alias("band"))
        finer = written(finer.select(F.array_sort(F.array_append("bucket", F.col("band"))).alias("bucket"), "node", "n").distinct(), "finer")
        links = written(links.union(alike(_promising(_stars(finer, percent), sets, percent))), "links")
        top = components(links)
        open_ = _open(member, top)
    more = alike(_across(open_, sets, banded, percent))
    return heads, top if more.isEmpty() else components(links.union(more))


def near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, for each row of docs."""
    sigs = written(signed(docs, width, places, rows), "signatures")
    heads, top = near_links(docs, sigs, width, percent)
    of = sigs.select("doc_id", "n", "d1", "d2").join(heads, ["d1", "d2", "n"], "left").join(top, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return of.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents of docs, with all columns, that are the smallest of their component. Rows with one doc_id stay or go together."""
    gone = concluded(lambda: near_copies(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti")


def op1(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
