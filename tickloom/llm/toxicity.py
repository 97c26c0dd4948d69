"""Toxicity by a learned lexicon: misspelled terms by Levenshtein automata, quotation told from abuse by the words around.

The lexicon (whole words and stems that are far more frequent in toxic texts) and the weights are learned from a bounded
sample of labelled rows, at most `SAMPLE`, taken by the order of a hash of doc_id. A hit is a term, its number of edits and
its context: quoted (inside quotation marks, or after a word of reporting), addressed (a word of address near it) or plain. Each
kind of hit has, by how often it occurs in a text, the log odds of such texts in the sample; kinds that are rare there lean on
all kinds with as many edits and the same context. The score is a logistic function of their sum over the whole text.

Labels, lang, source and doc_id are no inputs of a score. Null and empty texts have no hits and get the score of a text
without any. Without toxic and clean labelled rows the score is the share of toxic ones, 0 if there are none. Several
labels of one doc_id count as their highest; repeated rows of documents give repeated results. Texts are read whole, however long;
equal scores need no order; empty tables give no rows; extra columns are ignored (`without_toxic` keeps them).
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .lexicon import END, Matcher, Term, bare, chosen
from .shingles import shingle_sets
from .store import text_of, written

SAMPLE, FOLDS, NEAR, CLEAN_WORDS = 12_000, 5, 48, 400_000
OFTEN = 3  # hits of a kind in a text, from which on they count alike
LONGEST = 20  # letters of a beginning; a longer word is known by its first ones
SUPPORT = 5  # toxic texts that a term needs, however many there are
REPORT = frozenset("said says say wrote writes called calls quote quoted quotes word words term terms sagte sagt schrieb nannte wort dit disait écrit appelé mot dijo dice escribió llamó palabra".split())
ADDRESS = frozenset("you your you're u du dich dein deine ihr euch tu te toi vous ton ta tú usted eres vosotros".split())
_OPEN, _CLOSE = "\"“„«‚‘", "\"”“»’‘"
_TOKEN = re.compile(r"\S+")


def _context(text: str, a: int, b: int) -> str:
    before, after = text[max(0, a - NEAR):a].rpartition("\n")[2], text[b:b + NEAR].partition("\n")[0]
    marks = [c for c in before if c in "\"“”„«»"]
    opened = bool(marks) and (marks[-1] in "“„«" or marks[-1] == '"' and sum(c == '"' for c in marks) % 2 == 1) or before[-1:] in _OPEN and before != ""
    if opened and any(c in _CLOSE for c in after):
        return "quoted"
    words = [bare(w) for w in before.lower().split()]
    if any(w in REPORT for w in words[-4:]):
        return "quoted"
    if any(w in ADDRESS for w in [*words[-4:], *(bare(w) for w in after.lower().split()[:4])]):
        return "addressed"
    return "plain"


class Finder:
    """Hits of whole texts."""

    def __init__(self, terms: list[Term]):
        self.match, self.clean = Matcher(terms), set()

    def __call__(self, text: str) -> Counter:
        """Number of hits of each (term, edits, context)."""
        low = text.lower()
        words = set(low.split()) - self.clean
        if len(self.clean) > CLEAN_WORDS:
            self.clean = set()
        bad = {}
        for w in words:
            h = self.match.hits(bare(w))
            if h:
                bad[w] = min(h, key=lambda x: (x[1], x[0]))  # one word is one hit, of the nearest term
            else:
                self.clean.add(w)
        out: Counter = Counter()
        if bad:
            for m in _TOKEN.finditer(low):
                if m[0] in bad:
                    core = bare(m[0])  # marks around the word belong to its context
                    a = m.start() + m[0].find(core)
                    out[*bad[m[0]], _context(low, a, a + len(core))] += 1
        return out


class Model:
    """terms, weight of each kind of hit, slope and base of the logistic score."""

    def __init__(self, terms: list[Term], weights: dict, slope: float, base: float):
        self.terms, self.weights, self.slope, self.base = terms, weights, slope, base

    def evidence(self, hits: Counter) -> float:
        return sum(self.weights.get((*kind, min(n, OFTEN)), 0.0) for kind, n in hits.items())

    def score(self, evidence) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(evidence, dtype=float) + self.base, -500, 500)))


def _weights(terms: list[Term], rows: list[tuple[Counter, int]], n_bad: int, n_good: int) -> dict:
    """Log odds of each kind of hit and how often it occurs in the text (`OFTEN` times or more), between 0 and 6; texts count by
    the thousand of their label."""
    seen = (Counter(), Counter())
    for hits, y in rows:
        seen[y].update((*kind, min(n, OFTEN)) for kind, n in hits.items())
    rate = [Counter({kind: 1000 * n / total for kind, n in c.items()}) for c, total in zip(seen, (n_good, n_bad))]
    group = [Counter(), Counter()]
    for y in (0, 1):
        for (_, *kind), r in rate[y].items():
            group[y][tuple(kind)] += r
    out = {}
    for k, t in enumerate(terms):
        for e in range(t.edits + 1):
            for c in ("plain", "addressed", "quoted"):
                w = 0.0
                for n in range(1, OFTEN + 1):
                    # Before any row is seen: a hit is abuse three times out of four, a quotation every other time.
                    prior = (1, 1) if c == "quoted" else (1, 3)
                    share = (group[1][e, c, n] + prior[1]) / (group[0][e, c, n] + group[1][e, c, n] + sum(prior))
                    odds = (rate[1][k, e, c, n] + share) / (rate[0][k, e, c, n] + 1 - share)
                    w = max(w, float(np.clip(np.log(odds), 0, 6)))  # more hits never count less
                    out[k, e, c, n] = w
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and base by Newton steps; the ridge keeps separable samples finite."""
    w, a = np.zeros(2), np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out():
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # At most `sample` rows, so they may go to every task.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").select("text", "y")

    def marked(batches: Iterator[pd.DataFrame]):
        for b in batches:
            yield b.assign(h=[int(x.min()) - 2 ** 63 if len(x) else 0 for x in shingle_sets(b["text"].tolist())])

    # Copies and most near copies have the same lowest shingle; many of one text would look like many toxic words.
    rows = rows.mapInPandas(marked, "text string, y int, h long")
    rows = written(rows.groupBy("h", "y").agg(F.min("text").alias("text")), "labelled")
    count = Counter({int(r["y"] > 0): r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()})
    n_bad, n_good = count[1], count[0]
    if not n_bad or not n_good:
        return Model([], {}, 0.0, 500.0 if n_bad else -500.0)

    def beginnings(batches: Iterator[pd.DataFrame]):
        for b in batches:
            for i in range(0, len(b), 200):
                seen = [Counter() for _ in range(4)]  # toxic and clean texts with a beginning; with two or more of it
                for text, y in zip(b["text"].iloc[i:i + 200], b["y"].iloc[i:i + 200]):
                    words = Counter(w for w in map(bare, text.lower().split()) if 3 <= len(w) and w.isalpha())
                    times: Counter = Counter()
                    for w, n in words.items():
                        for k in range(3, min(len(w), LONGEST) + 1):
                            times[w[:k]] += n
                        if len(w) <= LONGEST:
                            times[w + END] += n
                    at = 0 if y > 0 else 1
                    seen[at].update(times.keys())
                    seen[at + 2].update(p for p, n in times.items() if n > 1)
                every = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"p": every} | {c: [x[p] for p in every] for c, x in zip(("bad", "good", "bad2", "good2"), seen)})

    # Only beginnings with enough toxic texts come to the driver: at most a fifth of those that the sample's toxic texts hold.
    counts = (rows.mapInPandas(beginnings, "p string, bad long, good long, bad2 long, good2 long").groupBy("p")
              .agg(*[F.sum(c).alias(c) for c in ("bad", "good", "bad2", "good2")]).where(F.col("bad") >= SUPPORT))
    terms = chosen({r["p"]: (r["bad"], r["good"], r["bad2"], r["good2"]) for r in counts.collect()}, n_bad, n_good, SUPPORT)

    def hits(batches: Iterator[pd.DataFrame]):
        find = Finder(terms)
        for b in batches:
            found = [find(t) for t in b["text"]]
            yield pd.DataFrame({"y": b["y"].array, "hits": ["\t".join(f"{k} {e} {c} {n}" for (k, e, c), n in h.items()) for h in found]})

    got = []
    for r in rows.mapInPandas(hits, "y int, hits string").collect():  # a short line for each row of the sample
        parts = [x.split() for x in r["hits"].split("\t") if x]
        got.append((Counter({(int(k), int(e), c): int(n) for k, e, c, n in parts}), int(r["y"] > 0)))
    weights = _weights(terms, got, n_bad, n_good)
    m = Model(terms, weights, 1.0, 0.0)
    m.slope, m.base = _logistic(np.array([m.evidence(h) for h, _ in got]), np.array([y for _, y in got], dtype=float))
    return m


def score_of(model: Model):
    """Column function: the score of a text, null as empty."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Finder(model.terms)
        for texts in batches:
            yield pd.Series(model.score([model.evidence(find(t)) if isinstance(t, str) else 0.0 for t in texts]))
    return score


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    score = score_of(learned(docs, labels, sample))
    s = docs.select("doc_id", held_out().alias("held_out"), score(text_of()).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all columns, whose score is below 0.5."""
    score = score_of(learned(docs, labels, sample))
    return docs.where(score(text_of()) < 0.5)


def op4(spark, sf_dir: str) -> DataFrame:
    return rated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
