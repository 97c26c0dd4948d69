"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go, the earliest stays.

Lines are cut at `\\n` and compared without outer spaces, tabs and carriage returns. A line takes part if it has `equal`
characters or more (1 in `without_repeated_lines` and in the registered query; as many as `least` in `line_report` unless
given), and in the search for near lines if it has `least`. A line goes if an equal line, or one within a bound of edits, stands before it in the order of
(doc_id, line number), whether that line itself stays or not; so the result doesn't depend on the order of the work. The bound
is 1 in `line_report` unless given; in `without_repeated_lines` it grows with the longer line (`Bound`).

The neighbourhood of a line is the line itself and the line without one character. Two lines at distance 1 by a replaced
character share a variant that lacks the same place; by an inserted one, the shorter line is a variant of the longer. All
variants of all lines would be as many rows as the table has characters, so they are emitted only where another line is
equal outside of the edited part: first lines are joined by equal halves (of a pair within one edit, one half is equal),
then by equal rests without one of `BLOCKS` parts, and for each part that has a partner the variants of that part are
emitted as hashed keys. None of these steps loses a pair. Members of a key are compared with its earliest line only, and
every pair is verified by its edit distance.

For bounds k of 2 and more a deletion neighbourhood has too many variants (k = 5 of 300 characters: 2 * 10**10), so there the keys are
substrings. Any line within k edits leaves a run of (n - k) / (k + 1) characters untouched; of each window of that length the
substring with the lowest hash is a key (`_run_keys`), so lines with a common run share a key. Lines that share one at places no
more than k apart are verified: first with the earliest line of the run, and only if that fails with all earlier ones. This loses no pair.

Null text has no lines. Rows without a doc_id come after all others. Rows equal in doc_id and text are one document and get
the same result; rows with one doc_id and different texts are told apart by the digest of the text.
"""
from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .pieces import slices
from .shingles import U, mix
from .store import concluded, let, text_of, written

LEAST, BLOCKS = 24, 8
MANY = 1 << 32  # more substrings than a slice of texts has
SLICE = 1 << 19  # characters
CELL = 64  # places; more than twice the bound
SMALL = 64  # lines of a run that is compared whole, in one lot with others
FAMILY = 2048  # lines of a lot, or of a larger run, that a task compares at once
BINS = 64
STRIP = 256  # lines of a block that are compared at a time
PAIRS = 8192  # pairs that are compared at a time
OUTER = " \t\r"
_BASE = 0xD6E8FEB86659FD93
_INVERSE = U(pow(_BASE, -1, 1 << 64))
_ID = ["a", "b"]  # a line's 128-bit digest


@dataclass(frozen=True)
class Bound:
    """Edits within which two lines are near, by the characters n of the longer one: 1 + n // per, at most `most`."""
    per: int = 1
    most: int = 1

    def of(self, n: int) -> int:
        return min(self.most, 1 + n // self.per)

    def column(self, n):
        return F.least(F.lit(self.most), 1 + F.floor(n / self.per)).cast("int")


ONE, GROWING = Bound(), Bound(per=50, most=5)


def texts_of(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """place (order of the line) and line: the lines that take part."""
    t = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = t.select("doc_id", "t", "line_no", F.btrim("line", F.lit(OUTER)).alias("line")).where(F.length("line") >= least)
    return line.select(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "t", "line_no").alias("place"), "line")


def lines_of(docs: DataFrame, least: int = LEAST, equal: int | None = None) -> DataFrame:
    """place, a and b (digest), n (characters), halves (keys; null under `least` characters) of the lines that take part."""
    x = texts_of(docs, least if equal is None else equal)
    halves = F.when(F.length("line") >= least, _halves(F.col("line")))
    return x.select("place", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.length("line").alias("n"), halves.alias("halves"))


def _half(n):
    return F.when(n < 64, F.floor(n / 2)).otherwise(8 * F.floor(n / 16)).cast("int")


def _halves(line):
    """Keys of the start and the end of a line. A line also has the keys of a line that is one character shorter."""
    n = F.length(line)
    ends = ((lambda h: F.left(line, h), "start"), (lambda h: F.right(line, h), "end"))
    return F.array_distinct(F.array(*[F.xxhash64(F.lit(name), h, cut(h)) for h in (_half(n), _half(n - 1)) for cut, name in ends]))


def _prefix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Running hashes of the characters of all texts, and where each text starts."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(t) for t in texts])
    at = np.r_[0, np.cumsum(size)]
    power = np.full(int(size.max(initial=0)) + 1, U(_BASE), dtype=U)
    power[0] = 1
    power = np.multiply.accumulate(power)
    place = np.arange(len(flat)) - np.repeat(at[:-1], size)
    return np.r_[np.zeros(1, dtype=U), np.cumsum(mix(flat.astype(U) + U(1)) * power[place], dtype=U)], at


def _parts(n: int, blocks: int):
    """(length compared, block, from, to) for lines of n characters: the block's bounds in this line, in its own length and as the longer of a pair."""
    for whole in (n, n - 1):
        cut = [k * whole // blocks for k in range(blocks + 1)]
        for k in range(blocks):
            yield whole, k, cut[k], n - (whole - cut[k + 1])


def _rest_keys(line: str, blocks: int) -> tuple[list[int], list[tuple]]:
    """Keys of a line without one of its parts, and the parts."""
    sums, _ = _prefix([line])
    n, parts = len(line), list(_parts(len(line), blocks))
    w, k, i, j = (np.array(x) for x in zip(*parts))
    # The rest behind the part is brought to the place it has in the shorter line, so that both lines hash it alike.
    back = np.ones(n + 1, dtype=U)
    back[1] = _INVERSE
    tail = (sums[n] - sums[j]) * np.multiply.accumulate(back)[np.minimum(n - w, 1)] if n else sums[j]
    key = mix(mix(sums[i] ^ mix(w.astype(U))) + mix(tail + k.astype(U)))
    return key.view(np.int64).tolist(), parts


def _variant_keys(rest: int, middle: str, longer: bool) -> tuple[list[int], str]:
    """Keys of a part's variants and their kind: S a replaced character, with its place; D a deleted one; W the part itself, last of S."""
    sums, _ = _prefix([middle])
    n, base = len(middle), mix(np.array([rest], dtype=np.int64).view(U))
    i = np.arange(n)
    lacking = sums[i] + (sums[n] - sums[i + 1]) * _INVERSE
    if longer:
        return np.unique(mix(lacking ^ base)).view(np.int64).tolist(), "D"
    s = mix(mix(lacking ^ base) + mix(i.astype(U) + U(3)))
    return np.r_[s, mix(sums[n:] ^ base)].view(np.int64).tolist(), "S"


def shared(keyed: DataFrame, by: list[str], *more: str) -> DataFrame:
    """The rows whose key stands in another line (a) too. There are many keys and few are shared, so they are moved once."""
    every = lambda c: c.over(Window.partitionBy(*by))
    return keyed.withColumns({"low": every(F.min("a")), "high": every(F.max("a"))}).where("low <> high").select(*by, "a", *more)


def fetched(docs: DataFrame, some: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """some lines (a, b, ...) with their first place and text. One row of each is fetched, by its first place, so a frequent line sends no
    more than a rare one."""
    where = some.join(classes, _ID).withColumnRenamed("place", "first").withColumn("h", F.xxhash64("first"))
    # A place is never null itself, and repeated rows meet in the task of their place, so they are dropped there.
    found = texts_of(docs, least).join(where, (F.xxhash64("place") == F.col("h")) & (F.col("place") == F.col("first")))
    return written(found.dropDuplicates(["h", "first", *_ID]).drop("first", "h"), "lines")


def near_lines(cand: DataFrame, classes: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """a, b of the lines in cand that have an earlier one at distance 1."""
    def rests(batches):
        for p in batches:
            rows = [(key, a, b) for a, b, x in zip(p["a"].tolist(), p["b"].tolist(), p["line"].tolist()) for key in _rest_keys(x, blocks)[0]]
            yield pd.DataFrame(rows, columns=["rest", "a", "b"]).drop_duplicates()

    rest = written(cand.select(*_ID, "line").mapInPandas(rests, "rest long, a long, b long"), "rests")
    shared = rest.groupBy("rest").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("rest")
    open_ = rest.join(shared, "rest", "left_semi").groupBy(*_ID).agg(F.collect_set("rest").alias("open"))  # at most 2 * blocks
    todo = cand.join(open_, _ID).select(*_ID, "line", "open")

    def variants(batches):
        for p in batches:
            texts = p["line"].tolist()
            for i, j in slices(texts, 1 << 18):
                rows = []
                for a, b, x, keys in zip(p["a"].tolist()[i:j], p["b"].tolist()[i:j], texts[i:j], p["open"].tolist()[i:j]):
                    keys = set(keys)
                    for key, (whole, _, f, t) in zip(*_rest_keys(x, blocks)):
                        if key in keys:
                            vs, kind = _variant_keys(key, x[f:t], len(x) > whole)
                            rows += [(v, kind, a, b) for v in vs]
                            if kind == "S":
                                rows[-1] = (vs[-1], "W", a, b)
                yield pd.DataFrame(rows, columns=["variant", "kind", "a", "b"]).drop_duplicates()

    v = written(todo.mapInPandas(variants, "variant long, kind string, a long, b long").join(classes, _ID), "variants")
    first = lambda kind: v.where(F.col("kind") == kind).groupBy("variant").agg(F.min(F.struct("place", "a", "b")).alias("first"))
    pairs = None
    for kind, other in (("S", "S"), ("D", "W"), ("W", "D")):
        near = v.where(F.col("kind") == kind).join(first(other), "variant").where(F.col("place") > F.col("first.place"))
        near = near.select("a", "b", F.col("first.a").alias("a0"), F.col("first.b").alias("b0"))
        pairs = near if pairs is None else pairs.union(near)
    texts = cand.select(*_ID, "line")
    sides = pairs.distinct().join(texts, _ID).join(texts.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("line").alias("line0")), ["a0", "b0"])
    return sides.where(F.levenshtein("line", "line0", 1).between(0, 1)).select(*_ID).distinct()


def _ladder(most: int = 1 << 30) -> list[int]:
    """Lengths of runs, each about a quarter longer than the one before."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


RUNS = _ladder()


@lru_cache(maxsize=1 << 16)
def _levels(m: int, bound: Bound) -> tuple[int, ...]:
    """Places in RUNS of the runs by which a line of m characters is keyed.

    If a line of n characters has one of m <= n within k = bound.of(n) edits, the edits leave k + 1 untouched pieces of it with n - k
    characters or more, so both share a run of (n - k) / (k + 1); the shorter line doesn't know n, so it takes the runs of every n."""
    runs = {-(-(n - k) // (k + 1)) for n in range(m, m + bound.most + 1) if (k := bound.of(n)) >= 2 and n - m <= k}
    return tuple(sorted({bisect_right(RUNS, r) - 1 for r in runs if r >= 1}))


def _least_of_windows(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from the running minima of blocks of w in both directions."""
    n = -(-len(x) // w) * w
    block = np.pad(x, (0, n - len(x)), constant_values=np.iinfo(U).max).reshape(-1, w)
    head = np.minimum.accumulate(block, axis=1).ravel()
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:len(x) - w + 1], head[w - 1:len(x)])


def _run_keys(texts: list[str], bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the runs of all lines: of each window of a run the substring with the lowest hash and the cell of its place,
    so that lines with a common run at places within the bound have a key in common."""
    sums, at = _prefix(texts)
    back = np.full(int(np.diff(at).max(initial=0)) + 1, _INVERSE, dtype=U)
    back[0] = 1
    back = np.multiply.accumulate(back)
    by: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        for level in _levels(len(t), bound):
            by.setdefault(level, []).append(i)
    out = []
    for level, rows in by.items():
        run = RUNS[level]
        q = min(run, max(14, run // 3))
        w, row = run - q + 1, np.array(rows)
        size = (at[row + 1] - at[row]) - q + 1  # substrings of q characters
        who = np.repeat(np.arange(len(row)), size)
        begin = np.r_[0, np.cumsum(size)]
        place = np.arange(begin[-1]) - begin[who]
        f = at[row][who] + place
        gram = mix((sums[f + q] - sums[f]) * back[place])
        low = _least_of_windows((gram & ~U(MANY - 1)) | np.arange(len(gram), dtype=U), w)
        first = np.arange(len(low))
        pick = np.unique(low[place[first] <= size[who[first]] - w] & U(MANY - 1)).astype(np.int64)
        for step in (-bound.most, bound.most):  # near a cell's border also the key of the next cell
            cell = (place[pick] + step) // CELL
            new = np.ones(len(pick), dtype=bool) if step < 0 else cell != (place[pick] - step) // CELL
            key = mix(gram[pick] ^ mix((cell * len(RUNS) + level).astype(U)))
            out.append((row[who[pick]][new], key.view(np.int64)[new]))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def run_shared(docs: DataFrame, classes: DataFrame, least: int, bound: Bound) -> DataFrame:
    """key, a, b, place and n (characters) of the distinct lines that share a run, at about the same place, with another one of about their
    length; a0 and n0 of the earliest of them, and how many there are (members)."""
    def keys(batches):
        for p in batches:
            texts, a = p["line"].tolist(), p["a"].to_numpy()
            for i, j in slices(texts, SLICE):
                row, key = _run_keys(texts[i:j], bound)
                yield pd.DataFrame({"key": key, "a": a[i:j][row]}).drop_duplicates()

    texts = texts_of(docs, least).where(F.length("line") + bound.most >= bound.per).select("line", F.xxhash64("line").alias("a"))
    sizes = F.sequence(F.floor((F.col("n") - bound.most) / CELL), F.floor((F.col("n") + bound.most) / CELL))
    every = lambda c: c.over(Window.partitionBy("key", "size"))
    earliest = F.min(F.struct("place", F.col("a").alias("a0"), F.col("n").alias("n0")))

    def runs() -> DataFrame:
        part = written(shared(texts.mapInPandas(keys, "key long, a long"), ["key"]).distinct(), "runs")
        part = part.join(classes.select(*_ID, "place", "n"), "a").withColumn("size", F.explode(sizes))
        part = part.withColumns({"low": every(F.min("a")), "high": every(F.max("a")), "first": every(earliest), "members": every(F.count("*"))})
        return part.where("low <> high").select("key", "size", "a", "b", "place", "n", "first.a0", "first.n0", "members")

    return concluded(runs, "open")


def far_lines(cand: DataFrame, open_: DataFrame, bound: Bound) -> DataFrame:
    """a, b of the lines in cand that have an earlier one within a bound of 2 or more.

    Lines that share a run (open_) are first compared with the earliest line of the run, which settles families of copies; only what
    stays open meets every earlier line of the run of about its length."""
    def verified(pairs: DataFrame) -> DataFrame:
        other = cand.select(F.col("a").alias("a0"), F.col("line").alias("line0"))
        k = bound.column(F.greatest(F.length("line"), F.length("line0")))
        sides = pairs.distinct().join(cand.select(*_ID, "line"), "a").join(other, "a0").withColumn("k", k)
        return sides.where("k >= 2 AND levenshtein(line, line0, k) BETWEEN 0 AND k").select(*_ID).distinct()

    by, near_length = ["key", "size"], F.abs(F.col("n") - F.col("n0")) <= bound.most
    later = F.col("a") != F.col("a0")
    settled = written(verified(open_.where(later & near_length).select("a", "a0")), "settled")
    # The earliest line of a run has met all others: it needs no earlier one, and what it hasn't settled isn't compared with it again.
    rest = open_.where(later & (F.col("members") > 2)).select(*by, "a", "place").join(settled.select("a", F.lit(True).alias("done")), "a", "left")
    return settled.union(verified(written(within_families(rest, cand, bound), "pairs")))


def _sketch(lines: list[str]) -> np.ndarray:
    """Counts of the pairs of neighbouring characters of each line, in BINS bins. An edit changes at most two pairs on either side."""
    out = np.zeros((len(lines), BINS), dtype=np.int32)
    for i, x in enumerate(lines):
        c = np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32).astype(U)
        out[i] = np.bincount((mix(c[:-1] * U(1 << 21) + c[1:]) % U(BINS)).astype(np.int64), minlength=BINS)
    return out


def _near(x: np.ndarray, y: np.ndarray, k: np.ndarray, sums: np.ndarray, at: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Whether line x[i] is within k[i] edits of line y[i], from the furthest place that e = 0, 1, ... edits reach on each diagonal.

    How far two lines agree is searched by halves over the hashes of their runs, so a pair costs the logarithm of its length."""
    n, m = at[x + 1] - at[x], at[y + 1] - at[y]
    ok, reach, rows = np.zeros(len(x), dtype=bool), np.zeros((len(x), 0), dtype=np.int64), np.arange(len(x))
    for e in range(int(k.max(initial=-1)) + 1):
        d = np.arange(-e, e + 1)
        end = np.minimum(n[:, None], m[:, None] - d)
        if e:
            old = np.pad(reach, ((0, 0), (2, 2)), constant_values=-MANY)
            i = np.minimum(np.maximum(np.maximum(old[:, 1:-1] + 1, old[:, :-2]), old[:, 2:] + 1), end)
        else:
            i = np.zeros_like(end)
        f, g = at[x][:, None] + i, at[y][:, None] + i + d
        low, high = np.zeros_like(end), end - i
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (sums[f + mid] - sums[f]) * back[i] == (sums[g + mid] - sums[g]) * back[i + d]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        reach = i + low
        ok |= (e <= k) & (np.abs(m - n) <= e) & (reach[rows, np.clip(m - n + e, 0, 2 * e)] >= n)
    return ok


def _first_near(texts: list[str], own: int, rank: np.ndarray, run: np.ndarray, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """For each of the first `own` texts one of the others in its run that comes before it (rank) and is within the bound, if there is one.

    Others whose sketches differ by more than 4 characters for each edit are left out, as that many edits can't make them. The closest
    by sketch is tried first, so that all others are only tried for texts that it doesn't settle."""
    (sums, at), sketch = _prefix(texts), _sketch(texts)
    back = np.full(int(np.diff(at).max(initial=0)) + 1, _INVERSE, dtype=U)
    back[0] = 1
    back, n = np.multiply.accumulate(back), np.diff(at)
    found, other = [], []
    by_run = own + np.argsort(run[own:], kind="stable")
    first, last = (np.searchsorted(run[by_run], run[:own], side=x) for x in ("left", "right"))
    for f in range(0, own, STRIP):
        xs, ys, ks, begin = [], [], [], [0]
        for i in range(f, min(f + STRIP, own)):
            y = by_run[first[i]:last[i]]
            y = y[(rank[y] < rank[i]) & (np.abs(n[y] - n[i]) <= bound.most)]
            k = np.minimum(bound.most, 1 + np.maximum(n[y], n[i]) // bound.per)
            far = np.abs(sketch[y] - sketch[i]).sum(axis=1)
            y, k, far = (z[(far <= 4 * k) & (np.abs(n[y] - n[i]) <= k)] for z in (y, k, far))
            by = np.argsort(far, kind="stable")
            xs, ys, ks = [*xs, np.full(len(y), i)], [*ys, y[by]], [*ks, k[by]]
            begin.append(begin[-1] + len(y))
        x, y, k = (np.concatenate(z) for z in (xs, ys, ks))
        closest = np.zeros(len(x), dtype=bool)
        closest[[b for b, c in zip(begin, begin[1:]) if b < c]] = True
        settled = np.zeros(own, dtype=bool)
        for todo in (np.flatnonzero(closest), np.flatnonzero(~closest)):
            for j in range(0, len(todo), PAIRS):
                t = todo[j:j + PAIRS]
                t = t[~settled[x[t]]]
                t = t[_near(x[t], y[t], k[t], sums, at, back)]
                _, one = np.unique(x[t], return_index=True)
                settled[x[t]] = True
                found, other = [*found, x[t][one]], [*other, y[t][one]]
    return tuple(np.concatenate(z) if z else np.zeros(0, dtype=np.int64) for z in (found, other))


def within_families(many: DataFrame, cand: DataFrame, bound: Bound) -> DataFrame:
    """a and an earlier a0 of the same run (key, size) within the bound, one in each block, for the lines that aren't done.

    Runs of up to SMALL lines are dealt whole to lots of about FAMILY lines. The lines of a larger run that aren't done are dealt to blocks of
    about FAMILY, and so are all lines of the run; each two blocks meet in one task, which holds no more than their lines however large the run
    is. No pair of lines is a row before it is found near."""
    by, id_type = ["key", "size"], many.schema["place"].dataType["doc_id"].dataType
    every = many.groupBy(*by).agg(F.count("*").alias("all"), F.count_if(F.col("done").isNull()).alias("open"))
    runs = written(every.where("open > 0 AND all > 1").withColumn("large", F.col("all") > SMALL), "families")
    lots = max(1, -(-(runs.where("NOT large").agg(F.sum("all")).first()[0] or 0) // FAMILY))
    lot = F.when(F.col("large"), F.col("key")).otherwise(F.pmod(F.xxhash64(*by), F.lit(lots)))
    blocks = lambda c: F.when(F.col("large"), F.ceil(F.col(c) / FAMILY)).otherwise(1)
    runs = runs.select(*by, "large", lot.alias("lot"), F.when(F.col("large"), F.col("size")).otherwise(-1).alias("part"), blocks("open").alias("rows"), blocks("all").alias("cols"))
    m = written(many.join(runs, by).join(cand.select("a", "line"), "a").select(
        *by, "large", "lot", "part", "rows", "cols", "a", "line", "done",
        "place.late", F.coalesce("place.doc_id", F.lit(0).cast(id_type)).alias("doc_id"), "place.t", "place.line_no"), "members")
    dealt = lambda n: F.pmod(F.xxhash64("a"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    order = ["late", "doc_id", "t", "line_no"]
    own = m.where("done IS NULL").withColumn("i", dealt("rows")).withColumn("j", each("cols"))
    met = m.withColumn("j", dealt("cols")).withColumn("i", each("rows"))
    block = ["large", "lot", "part", "i", "j"]

    def compare(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([p, q], ignore_index=True)
        rank, run = (both.groupby(c, sort=True, dropna=False).ngroup().to_numpy() for c in (order, by))
        x, y = _first_near(both["line"].tolist(), len(p), rank, run, bound) if len(p) and len(q) else ([], [])
        a = both["a"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"a": a[x], "a0": a[y]} if len(x) else {"a": a[:0], "a0": a[:0]})

    cols = [F.col(c).alias(c) for c in (*block, *by, "a", "line", *order)]  # new names, as both sides come from one table
    return own.select(cols).groupBy(*block).cogroup(met.select(cols).groupBy(*block)).applyInPandas(compare, "a long, a0 long").distinct()


def repeated_lines(docs: DataFrame, least: int = LEAST, equal: int | None = None, bound: Bound = ONE) -> DataFrame:
    """doc_id, t (digest of the text), dropped: the numbers of the lines that go, in order. Documents that lose none are left out."""
    lines = written(lines_of(docs, least, equal), "places")
    classes = written(lines.groupBy(*_ID).agg(F.min("place").alias("place"), F.min("n").alias("n")), "classes")
    some = shared(lines.select(F.explode("halves").alias("half"), "a"), ["half"]).select("a").distinct()
    some = some.join(classes.select(*_ID), "a").select(*_ID).withColumn("half", F.lit(True))
    if bound.most > 1:
        open_ = run_shared(docs, classes, least, bound)
        some = some.join(open_.select(*_ID).distinct().withColumn("run", F.lit(True)), _ID, "full")
    cand = fetched(docs, some, classes.drop("n"), least)
    one = lambda: near_lines(cand.where("half"), classes)
    near = concluded((lambda: one().union(far_lines(cand.where("run"), open_, bound)).distinct()) if bound.most > 1 else one, "near")
    keep = classes.join(near, _ID, "left_anti").select(*_ID, F.col("place").alias("stays"))
    places = lines.select(*_ID, "place").join(keep, _ID, "left")
    gone = places.where(F.col("stays").isNull() | (F.col("stays") != F.col("place")))
    return gone.select("place.doc_id", "place.t", "place.line_no").groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def line_report(docs: DataFrame, least: int = LEAST, equal: int | None = None, bound: Bound = ONE) -> DataFrame:
    """doc_id, n_lines (that take part), n_dropped, dropped (numbers of the lines that go, from 0, joined by commas)."""
    gone = concluded(lambda: repeated_lines(docs, least, equal, bound), "gone").select(F.col("doc_id").alias("id"), F.col("t").alias("u"), "dropped")
    n = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(OUTER))) >= (least if equal is None else equal)))
    d = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("t"), n.cast("long").alias("n_lines"))
    j = d.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("u")), "left")
    return j.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, least: int = LEAST, equal: int | None = 1, bound: Bound = GROWING) -> DataFrame:
    """docs with all columns; text lacks the lines that go, n_chars (where there is one) is counted anew."""
    gone = concluded(lambda: repeated_lines(docs, least, equal, bound), "gone").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("dropped").alias("__dropped"))
    j = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__t")), "left")
    left = lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__dropped")), lambda i: F.get(ls, i)), "\n")
    text = F.when(F.col("__dropped").isNull(), docs["text"]).otherwise(let(F.split(docs["text"], "\n"), left))
    out = j.withColumn("text", text).drop("__id", "__t", "__dropped")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2(spark, sf_dir: str) -> DataFrame:
    """Every line that isn't empty takes part; near lines are those within one edit, of LEAST characters or more."""
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), equal=1)


_SQL_HALF = "CASE WHEN {0} < 64 THEN {0} // 2 ELSE 8 * ({0} // 16) END"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, trim(ls[i], ' ' || chr(9) || chr(13)) AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
lines AS (SELECT *, length(x) AS n FROM l WHERE length(x) >= 1),
classes AS (SELECT x, n, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS place FROM lines GROUP BY x, n),
h AS (SELECT *, unnest(list_distinct([{_SQL_HALF.format("n")}, {_SQL_HALF.format("(n - 1)")}])) AS h FROM classes WHERE n >= {LEAST}),
k AS (SELECT x, n, place, 's' || h || ':' || left(x, h) AS k FROM h UNION ALL SELECT x, n, place, 'e' || h || ':' || right(x, h) FROM h),
pairs AS (SELECT DISTINCT p.x AS x, q.x AS y, p.n AS n, q.n AS m FROM k p JOIN k q ON p.k = q.k AND q.place < p.place AND abs(p.n - q.n) <= 1),
first AS (SELECT *, coalesce(list_min(list_filter(range(1, least(n, m) + 1), lambda i: x[i] <> y[i])), least(n, m) + 1) AS i FROM pairs),
near AS (SELECT DISTINCT x FROM first WHERE CASE WHEN n = m THEN substr(x, i + 1) = substr(y, i + 1) WHEN n > m THEN substr(x, i + 1) = substr(y, i) ELSE substr(x, i) = substr(y, i + 1) END),
gone AS (SELECT l.doc_id, l.line_no FROM lines l JOIN classes c ON c.x = l.x
         WHERE struct_pack(doc_id := l.doc_id, line_no := l.line_no) <> c.place OR l.x IN (SELECT x FROM near)),
per AS (SELECT doc_id, count(*) AS n_dropped, string_agg(line_no, ',' ORDER BY line_no) AS dropped FROM gone GROUP BY 1)
SELECT d.doc_id, cast(len(list_filter(ls, lambda z: length(trim(z, ' ' || chr(9) || chr(13))) >= 1)) AS bigint) AS n_lines,
       coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
"""
