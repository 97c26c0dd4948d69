"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest piece that fits. Then, if its smallest piece can give way to two unpacked pieces
that fill the widened gap better, the two take its place. Pieces of one length are alike, so the packing works on the
number of pieces of each length (at most `size` numbers, whatever the table): a bin's lengths are a pattern, and the
pattern repeats until one of its lengths runs out, exactly as bin after bin would. Every piece is then numbered within its
length by counts of cells, and looks its place up in the patterns. Nothing else goes through the driver.

Null and empty texts are one piece that holds the end id alone. Repeated rows are packed as often as they occur.
"""
from __future__ import annotations

import re
import string
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .pieces import slices
from .store import written

SIZE = 4096
CELL = 100_000
CACHE_WORDS = 240_000  # kept, and as many seen once
#: A private-use character between words: its ids mark where a word ends. Words that hold it are encoded alone.
FENCE = "\ue000"
#: A full stop or comma before a space with another mark before it. The rare characters come first, as a search is quick to pass what lacks them.
_MARKS = re.compile(r"[.,] (?<=[\W_][.,] )(?<!\s[.,] )")


def _beyond(text: str) -> bool:
    """Whether a text has characters beyond U+017F, or U+0130, whose lower case is two characters."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return bool(c.max(initial=0) > 0x17F or (c == 0x130).any())


@lru_cache(maxsize=1)
def tokenizer(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_level() -> dict[int, int]:
    """Bytes as the printable characters that byte-level vocabularies write for them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


class WordIds:
    """Ids of whole texts from the ids of their words, which are kept for later texts.

    Words end at spaces and line ends, which the tokenizer drops; words of Latin letters, with or without one mark behind
    them or a run of marks, go to its merges directly, others through all its steps. Whether both hold is tried on the file itself
    (`splits`, `direct`); if not, the longer way is taken.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.t, self.most = tokenizer(path), most
        self.model = self.t.model  # a new object each time it is asked for
        self.known: dict[str, bytes] = {"": b""}
        self.once: set[str] = set()
        self.bytes = _byte_level()
        self.fence = np.array(self._plain(FENCE), dtype=np.uint32)
        self.marks = {m: self._raw(self._plain(m)) for m in ".,;:!?"}
        a, b = "word's", "9é, x"
        self.splits = all(self._plain(f"{a}{s}{b}{s}") == self._plain(a) + self._plain(b) for s in (" ", "\n", "\n \n")) and not any(
            x.lstrip or x.rstrip or x.single_word or " " in x.content or "\n" in x.content for x in self.t.get_added_tokens_decoder().values())
        tries = ("Word", "Éléphantesque", "straße", "ñandúes", "antidisestablishmentarianism", "xqzjk", "Œuvre", "ŁÓDŹ", "a")
        self.special = [x.content.lower() for x in self.t.get_added_tokens_decoder().values()]
        self.direct = all(self._letters(w) + ids == self._raw(self._plain(w + m)) for w in tries for m, ids in [("", b""), *self.marks.items()])
        # Marks behind letters are a token run of their own, unless an added token could be cut out of them.
        self.runs = all(x and not x[0].isalpha() and any(c.isalpha() for c in x) for x in self.special) and all(
            self._letters(w) + self._raw(self._plain(m)) == self._raw(self._plain(w + m)) for w in tries for m in ("&&&", "!'", "'", "',.\"", "_-", string.punctuation))
        self.ends: dict[str, bytes] = {}

    def _plain(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of letters; None if it has letters beyond U+017F."""
        low = word.lower()
        if not word.isascii():
            if max(word) > "\u017f" or not low.isalpha():
                return None
            low = str(low.encode(), "latin-1").translate(self.bytes)
        return array("I", [i.id for i in self.model.tokenize(low)]).tobytes()

    def _learn(self, new) -> None:
        rest, known, letters, marks = [], self.known, self._letters, self.marks
        # Other letters may turn into one with a mark behind, which joins the marks that follow (U+0130), so these words go whole.
        base_ids = lambda x: x.isascii() and known.get(x) or letters(x)
        for w in new if self.direct else ():
            if w.isalpha():
                ids = letters(w)
            elif w[-1] in marks and w[:-1].isalpha():
                ids = base_ids(w[:-1])
                ids = ids and ids + marks[w[-1]]
            elif self.runs and (base := w.rstrip(string.punctuation)).isalpha():
                ids = base_ids(base)
                ids = ids and ids + self._end(w[len(base):])
            else:
                ids = None
            if ids is None:
                rest.append(w)
            else:
                known[w] = ids
        self._ask(rest if self.direct else list(new))

    def _end(self, marks: str) -> bytes:
        """Ids of a run of ASCII marks."""
        if (ids := self.ends.get(marks)) is None:
            ids = self._raw(self._plain(marks))
            if len(marks) <= 8 and len(self.ends) < 10_000:
                self.ends[marks] = ids
        return ids

    def _ask(self, new: list[str]) -> None:
        apart = [w for w in new if FENCE in w]
        for w in apart:
            self.known[w] = np.array(self._plain(w), dtype="<u4").tobytes()
        new = [w for w in new if FENCE not in w]
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            ids = np.array(self._plain(f" {FENCE} ".join(some)), dtype="<u4")
            n = len(self.fence)
            at = np.flatnonzero(ids[:len(ids) - n + 1] == self.fence[0])
            at = at[np.all([ids[at + k] == self.fence[k] for k in range(n)], axis=0)] if len(at) else at
            if len(at) != len(some) - 1:
                raise ValueError("the fence is not unique among the ids")
            for w, a, b in zip(some, np.r_[0, at + n].tolist(), np.r_[at, len(ids)].tolist()):
                self.known[w] = ids[a:b].tobytes()

    def _plainer(self, text: str) -> str:
        """The text with the same ids and fewer different words: in lower case, commas and full stops apart from their words.

        Only for Latin letters without combining marks, where no mark stands before a comma or a full stop, which would be one
        word with it, and where no special token would come of it."""
        if self.direct and (text.isascii() or not _beyond(text)):
            low = text.lower()
            if not any(s in low for s in self.special):
                text = low if _MARKS.search(low) else low.replace(", ", " , ").replace(". ", " . ")
        return text

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.splits:
            return [self._raw(self._plain(t)) for t in texts]
        split = [self._plainer(t.replace("\n", " ")).split(" ") for t in texts]
        words = set().union(*split)
        new = words - self.known.keys()
        self._learn(new)
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        # Most words occur once: a word is kept when it comes a second time.
        rare = new - self.once
        for w in rare:
            del self.known[w]
        self.once = rare if len(self.once) > self.most else self.once | rare
        if len(self.known) > self.most:
            self.known = {"": b""}
        return out


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """Kept by the worker from task to task."""
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids: the ids of every whole text with end_id behind, cut into pieces of `size`.

    Without `with_ids` the ids themselves stay in the task that makes them.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        words = word_ids(path)
        for b in batches:
            texts = b["text"].fillna("").tolist()
            for i, j in slices(texts):
                rows = []
                for d, raw in zip(b["doc_id"].iloc[i:j].tolist(), words.encode(texts[i:j])):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[at:at + 4 * size]
                        rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInPandas(run, schema)


def patterns(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(number of bins, their lengths) from the number of pieces of each length, by best-two-fit."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    free = left > 0
    below = np.maximum.accumulate(np.where(free, np.arange(size + 1), 0))  # longest unpacked length up to each length

    def change(length: int, by: int) -> None:
        left[length] += by
        if (left[length] > 0) != free[length]:
            free[length] = left[length] > 0
            above = np.flatnonzero(free[length + 1:])
            stop = length + 1 + above[0] if len(above) else size + 1
            below[length:stop] = length if free[length] else below[length - 1]

    out = []
    while below[size]:
        gap, bin_ = size, []
        while gap and below[gap]:
            x = int(below[gap])
            bin_.append(x)
            change(x, -1)
            gap -= x
        if gap and len(bin_) > 1:
            small = bin_[-1]
            wide = gap + small
            a = np.flatnonzero(free[:wide])
            b = below[wide - a]
            ok = (b > 0) & ((b != a) | (left[a] > 1))
            total = np.where(ok, a + b, 0)
            if len(a) and total.max() > small:
                k = int(total.argmax())
                bin_[-1:] = sorted((int(a[k]), int(b[k])), reverse=True)
                change(small, 1)
                change(int(a[k]), -1)
                change(int(b[k]), -1)
        used = Counter(bin_)
        more = int(min(left[x] // n for x, n in used.items()))
        for x, n in used.items():
            if more:
                change(x, -more * n)
        out.append((1 + more, bin_))
    return out


def numbered(pieces: DataFrame, n_rows: int, cell: int = CELL) -> DataFrame:
    """pieces with `nth`, a number from 0 within each length. Lengths are cut into cells of about `cell` rows, which are counted
    first, so a frequent length is spread over many tasks."""
    cells = max(1, -(-n_rows // cell))
    p = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)))
    counts = p.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = counts.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return p.withColumn("inside", inside).join(before, ["length", "cell"]).withColumn("nth", F.col("before") + F.col("inside")).drop("cell", "inside", "before")


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. They are read more than once: pass a written table."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # Rows of the place table: within its length, pieces first.. go to bins base.. , `each` to a bin, at `offsets`.
    first, base, by_length = Counter(), 0, {x: ([], [], [], []) for x in counts}
    for bins, lengths in patterns(counts, size):
        at, offsets = 0, {}
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, offs in offsets.items():
            for column, value in zip(by_length[x], (first[x], base, len(offs), offs)):
                column.append(value)
            first[x] += bins * len(offs)
        base += bins
    # Bounded by the number of lengths, not by the table; goes to the tasks with the function.
    places = {x: (np.array(f), np.array(b), np.array(e), np.array([o for os in offs for o in os]), np.cumsum([0, *e])) for x, (f, b, e, offs) in by_length.items()}

    def place(batches):
        for b in batches:
            seq, off = np.empty(len(b), dtype=np.int64), np.empty(len(b), dtype=np.int64)
            length, nth = b["length"].to_numpy(), b["nth"].to_numpy()
            by = np.argsort(length, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(length[by])) + 1) if len(by) else []:
                start, bin0, each, offs, offs_at = places[int(length[rows[0]])]
                k = np.searchsorted(start, nth[rows], side="right") - 1
                r = nth[rows] - start[k]
                seq[rows] = bin0[k] + r // each[k]
                off[rows] = offs[offs_at[k] + r % each[k]]
            yield b.drop(columns="nth").assign(sequence_id=seq, offset=off)

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = numbered(pieces.select(columns), sum(counts.values()))
    return rows.select(*columns, "nth").mapInPandas(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed token sequences themselves: sequence_id, n_tokens, ids (little-endian unsigned 32-bit).

    Pieces with the same doc_id, piece and start are told apart by their ids_crc32 and otherwise alike."""
    key = ["doc_id", "piece", "start", "ids_crc32"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("length"))
    of = placed.withColumn("copy", number).alias("a")
    ids = pieces.withColumn("copy", number).select(*key, "copy", "ids").alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "copy"]]
    rows = of.join(ids, same).select("a.sequence_id", "a.offset", "a.length", "b.ids")
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", "n_tokens", joined.alias("ids"))


def packed_documents(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    cut = written(token_pieces(docs, path, size=size, with_ids=False), "pieces")
    return packed(cut, size)


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
