"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, n_tokens). Contents are joined to it; only the distinct
contents that miss are encoded, by the tokenizer's own library, and appended. The tokenizer digest covers the file, the
library with its version, and the options, so a changed tokenizer never meets old counts.

Normalised content is the text itself, null as empty: any other folding could change a count. One result row for each
input row; repeated rows and copies are encoded once. Rows appended twice by concurrent runs count as one.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from importlib.metadata import version

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .store import scratch, text_of, written

OPTIONS = "no begin, end or added special tokens; whole text"
CACHE_SCHEMA = "tokenizer string, content binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {version(library)}; {OPTIONS}; ".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


@lru_cache(maxsize=2)
def counter(path: str):
    """Function from texts to token counts."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(sp.encode(t)) for t in texts]
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(t.encode(x, add_special_tokens=False)) for x in texts]


def stored(spark, cache: str, tokenizer: str) -> DataFrame:
    """Counts of this tokenizer in the cache, one for each content; none where there is no cache yet."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of docs. Appends to the table at `cache`."""
    spark, tokenizer = docs.sparkSession, tokenizer_digest(path)
    keyed = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("content"))
    rows = written(keyed.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "contents")
    # One document stands for each missing content, so that copies are neither moved nor encoded together.
    misses = (rows.groupBy("content").agg(F.min("doc_id").alias("first_id"))
              .join(stored(spark, cache, tokenizer), "content", "left_anti").withColumnRenamed("content", "missing"))
    todo = (keyed.join(misses, (F.col("content") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
            .select("content", "text"))

    def encode(batches):
        count = counter(path)
        for b in batches:
            yield pd.DataFrame({"content": b["content"].array, "n_tokens": count(b["text"].tolist())})

    fresh = todo.mapInPandas(encode, "content binary, n_tokens long").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    (fresh.select(F.lit(tokenizer).alias("tokenizer"), "content", "n_tokens")
     .write.mode("append").option("compression", "zstd").parquet(cache))
    return (rows.join(stored(spark, cache, tokenizer), "content")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def op3(spark, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that the result never depends on earlier runs."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return counted(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch(spark, "token-counts"))
