import hashlib
import random

import public_tokenizers
from sentencepiece import SentencePieceProcessor

from tickloom.llm.pieces import Words, decoded, encoded, model, piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "ß", "漢", "😀", "\t", "aaaa", "....", "====", "<s>", "</s>", "<0x41>", "́", "\x00", "0", "(", "--", "_", "ing", "\r\n", "​", "<unk>"]
    out = ["", " ", "  a", "▁", "▁▁ a", "\n", " \n ", "a" * 999, "ab" * 400, "=" * 333]
    out += ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    return out + ["".join(chr(r.choice([r.randint(1, 0x250), r.randint(0x250, 0x3000), r.randint(32, 126)])) for _ in range(r.randint(1, 60))) for _ in range(1000)]


def test_same_as_the_library():
    sp, words, ts = SentencePieceProcessor(model_file=PATH), Words(PATH, most=500), texts()
    for i in range(0, len(ts), 200):
        for t, ids in zip(ts[i:i + 200], words.ids(ts[i:i + 200])):
            assert ids == sp.encode(t)
            assert model(PATH).decode(ids) == sp.decode(ids)


def test_decoding_of_any_ids():
    sp, r = SentencePieceProcessor(model_file=PATH), random.Random(2)
    for _ in range(2000):
        ids = [r.choice([r.randint(3, 300), r.randint(3, 31999)]) for _ in range(r.randint(0, 12))]
        assert model(PATH).decode(ids) == sp.decode(ids)


def test_tables(spark):
    sp = SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "x") for i, t in enumerate(texts()[:200])] + [(500, None, None), (None, "a b", "y"), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(x.doc_id), x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in piece_digests(df, PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((str(i), len(sp.encode(t or "")), sha(",".join(map(str, sp.encode(t or "")))), sha(sp.decode(sp.encode(t or "")))) for i, t, _ in rows)
    e = encoded(df, PATH)
    back = {x.doc_id: x.text for x in decoded(e, PATH).collect()}
    assert back[None] == "a b" and back[500] == "" and {x.doc_id: list(x.ids) for x in e.collect()}[500] == []
    assert piece_digests(df.limit(0), PATH).count() == 0
