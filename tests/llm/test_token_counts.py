import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tickloom.llm.store import scratch
from tickloom.llm.token_counts import counted, stored, tokenizer_digest

SCHEMA = "doc_id long, text string, content string, n_tokens string"
ROWS = [(1, "one two three"), (2, "one two three"), (2, "one two three"), (3, None), (4, ""), (5, "<s> é 😀 " * 2000), (None, "no id"), (None, "no id"), (6, "<|endoftext|> x")]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_and_cache(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        sp = SentencePieceProcessor(model_file=path)
        n = lambda t: len(sp.encode(t))
    else:
        tk = Tokenizer.from_file(path)
        n = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    cache = scratch(spark, "test-cache")
    want = sorted((str(i), len((t or "").encode()), n(t or ""), n(t or "") > 4096) for i, t in ROWS)
    rows_of = lambda d: sorted((str(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in d.collect())
    assert rows_of(counted(df, path, cache)) == want
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for _, t in ROWS})
    # The second run encodes nothing; a third one only what is new. Counts of the cache are taken as they stand.
    assert rows_of(counted(df, path, cache)) == want and spark.read.parquet(cache).count() == before
    more = spark.createDataFrame([(9, "new text", "", ""), (1, "one two three", "", "")], SCHEMA)
    assert len(rows_of(counted(more, path, cache))) == 2 and spark.read.parquet(cache).count() == before + 1
    assert stored(spark, cache, "another tokenizer").count() == 0
    assert counted(df.limit(0), path, scratch(spark, "test-cache")).count() == 0


def test_digest_depends_on_the_file():
    assert len({tokenizer_digest(public_tokenizers.path(x)) for x in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json")}) == 3
