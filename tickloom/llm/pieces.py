"""SentencePiece BPE by vectorised merge rounds, and back.

All words of a batch of texts lie in one flat symbol array. A round takes, for every word, the lowest pair rank of its
segment and merges that pair at all places at once, leftmost first; merged places are compacted away, and words without a
pair left are done. Merging all places at once equals one merge at a time unless a product can pair at a better rank than
its own, or two pieces share a rank: those merge at the leftmost place only.

A word ends before a space mark that follows something else, and at a line end, because no piece crosses these (checked
when the model is read; otherwise the whole text is one word). Words recur, so a task keeps the results of up to
`CACHE_WORDS` of them and starts afresh beyond that.

Null text counts as empty and has no ids. Repeated rows give repeated results; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MARK = "▁"
NONE = np.int32(np.iinfo(np.int32).max)
CACHE_WORDS = 300_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    """Tables of a .model file: BPE with byte fallback and no normalisation but the space mark."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        kinds = {p.type for p in m.pieces}
        if (t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix
                or not n.escape_whitespaces or t.treat_whitespace_as_suffix or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}):
            raise ValueError(f"{path}: only BPE models with byte fallback, identity normalisation and a leading space mark are supported")
        normal = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.n_pieces = len(m.pieces)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.surface: list[bytes | int] = [b""] * self.n_pieces
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface[i] = int(p.piece[3:5], 16)
            elif p.type == NORMAL:
                self.surface[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == UNKNOWN:
                self.surface[i] = t.unk_surface.encode()
        # A symbol is a piece id, or n_pieces + code point for a character without a piece.
        symbol = lambda s: normal.get(s, self.n_pieces + ord(s) if len(s) == 1 else -1)
        self.single = {c: i for c, i in normal.items() if len(c) == 1}
        scores = np.array([p.score for p in m.pieces], dtype=np.float32)
        long = [(s, i) for s, i in normal.items() if len(s) > 1]
        order, rank = np.unique(-scores[[i for _, i in long]], return_inverse=True)
        rank_of = dict(zip((i for _, i in long), rank.tolist()))
        shared = np.bincount(rank, minlength=len(order)) > 1
        held = {i for _, i in long if shared[rank_of[i]]}
        pairs = []
        for s, i in long:
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a >= 0 and b >= 0:
                    pairs.append((a << 32 | b, rank_of[i], i))
                    held |= {q for q in (a, b) if rank_of.get(q, -1) > rank_of[i]}
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], dtype=np.int64)
        self.rank = np.array([p[1] for p in pairs] + [NONE], dtype=np.int32)
        self.product = np.array([p[2] for p in pairs] + [0], dtype=np.int32)
        self.one_by_one = np.array([p[2] in held for p in pairs] + [False])
        chars = {c for s, _ in long for c in s}
        crossing = any(re.search(f"[^{MARK}]{MARK}", s) for s, _ in long)
        cut = "\n" not in chars
        self.words = re.compile(".+" if crossing else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if cut else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)
        self.table = np.arange(self.n_pieces, self.n_pieces + 0x110000, dtype=np.int32)
        for c, i in self.single.items():
            self.table[ord(c)] = i

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs in the tables; the last place for pairs that make no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys)).astype(np.int32)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words (none of them empty) after all merges, one word after the other, and where each word ends."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym, word = self.table[flat], np.repeat(np.arange(len(words), dtype=np.int32), size)
        last = len(self.keys)
        slot = np.full(len(sym), last, dtype=np.int32)
        inside = np.flatnonzero(word[:-1] == word[1:])
        slot[inside] = self.slots(sym[inside], sym[inside + 1])
        done_sym, done_word = [], []
        while len(sym):
            rank = self.rank[slot]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            spans = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, starts), spans)
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                go = ~over
                sym, word, slot, rank, best = sym[go], word[go], slot[go], rank[go], best[go]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            same = np.r_[False, word[at[1:]] == word[at[:-1]]]
            # Of touching places every second one merges, from the left; held pieces only at the first place of a word.
            fresh = ~(same & np.r_[False, np.diff(at) == 1])
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            take = ((np.arange(len(at)) - lead) % 2 == 0) & ~(same & self.one_by_one[slot[at]])
            at = at[take]
            sym[at] = self.product[slot[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, slot = sym[keep], word[keep], slot[keep]
            at = place[at]
            left = at[at > 0] - 1
            for x in (at, left):
                y = np.minimum(x + 1, len(sym) - 1)
                slot[x] = np.where((y > x) & (word[x] == word[y]), self.slots(sym[x], sym[y]), last)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        return sym[by], np.cumsum(np.bincount(word, minlength=len(words)))

    def ids(self, symbols: list[int]) -> list[int]:
        """Symbols as ids; a character without a piece becomes the ids of its bytes."""
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.n_pieces else self.byte_ids[list(chr(s - self.n_pieces).encode())].tolist()
        return out

    def decode(self, ids) -> str:
        """Text of ids, without the space of the leading mark; bytes that make no character become U+FFFD each."""
        out, raw, first = [], bytearray(), True

        def flush() -> None:
            k = 0
            while k < len(raw):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(raw[k:k + width].decode())
                        k += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k += 1
            raw.clear()

        for i in ids:
            s = self.surface[i]
            if isinstance(s, int):
                raw.append(s)
                first = False
                continue
            flush()
            s = s.decode()
            out.append(s[1:] if first and s[:1] == " " else s)
            first = first and not s
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


class Words:
    """Ids of whole texts, put together from the words of a batch; only words not seen before are merged."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.model, self.most = model(path), most
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.number = [str(i) for i in range(self.model.n_pieces)]
        self.surface = [s.decode() if isinstance(s, bytes) else None for s in self.model.surface]

    def split(self, text: str) -> list[str]:
        return self.model.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, split: list[list[str]]) -> None:
        new = {w for ws in split for w in ws if w not in self.ids_of}
        if len(self.ids_of) + len(new) > self.most:
            self.ids_of, self.text_of = {}, {}
            new = {w for ws in split for w in ws}
        if not new:
            return
        words = list(new)
        flat, ends = self.model.merge(words)
        unknown = np.logical_or.reduceat(flat >= self.model.n_pieces, np.r_[0, ends[:-1]]).tolist()
        flat, a = flat.tolist(), 0
        for w, b, bare in zip(words, ends.tolist(), unknown):
            if bare:
                ids = self.model.ids(flat[a:b])
                text = self.model.decode([self.model.byte_ids[ord("x")], *ids])[1:]  # behind another piece a mark keeps its space
            else:
                ids = flat[a:b]
                text = "".join([self.surface[i] for i in ids])
            self.ids_of[w] = ",".join([self.number[i] for i in ids])
            self.text_of[w] = text
            a = b

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, digest of the ids, digest of the decoded text) of each text."""
        split = [self.split(t) for t in texts]
        self.learn(split)
        out = []
        for ws in split:
            ids = ",".join(map(self.ids_of.__getitem__, ws)).encode()
            text = "".join(map(self.text_of.__getitem__, ws))[1:].encode()  # the first mark loses its space
            out.append((ids.count(b",") + 1 if ws else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out

    def ids(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        self.learn(split)
        return [[int(x) for w in ws for x in self.ids_of[w].split(",")] for ws in split]


@lru_cache(maxsize=1)
def known_words(path: str) -> Words:
    """Kept by the worker from task to task."""
    return Words(path)


def slices(texts: list[str], chars: int = 1 << 21):
    """Ranges of rows with about so many characters, so that long texts don't pile up in a task."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and `ids`: the piece ids of each whole text."""
    def run(batches):
        words = known_words(path)
        for b in batches:
            texts = b["text"].fillna("").tolist()
            for i, j in slices(texts):
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "ids": words.ids(texts[i:j])})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and `text` of rows of doc_id and `ids`; null ids count as none."""
    def run(batches):
        m = model(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "text": [m.decode(x) if x is not None else "" for x in b["ids"]]})
    return ids.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them."""
    def run(batches):
        words = known_words(path)
        for b in batches:
            texts = b["text"].fillna("").tolist()
            for i, j in slices(texts):
                n, ids, text = zip(*words.digests(texts[i:j]))
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[i:j].array, "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
