"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of `[^\\x20\\x09-\\x0D]`, lines are cut at `\\n`. A null or empty text has no words and no lines, all its counts
are 0 and it fails. Rows pass through one by one: repeated rows give repeated results, other columns are ignored.
Repeated word windows are compared by their 64-bit xxhash.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import let, text_of

SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5

#: Common words of the languages of the corpus, in lower case.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or an "
    "der die das und in zu den mit von ist im des ein eine auf nicht dem sich auch es an "
    "de la le les et des en un une du que pour dans qui est pas sur au par avec "
    "el los las y que en un una por con se del al su para es no lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes where low <= part / whole <= high; a whole of 0 passes. least: words from which on the rule holds."""
    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The production table: lengths, symbols, stop words, lines.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("marks_per_word", "n_marks", "n_words", None, 0.5),
    Rule("upper_words", "n_upper_words", "n_words", None, 0.5, 20),
    Rule("stop_words", "n_stop_words", "one", 1, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 1.5, None, 50),
)


def _repeated(w: Column) -> Column:
    """Words inside windows of WINDOW words that are found twice or more."""
    def covered(s: Column) -> Column:
        places = F.transform(s, lambda e, i: F.when(
            F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)), e["p"]))
        return F.aggregate(
            F.array_sort(F.filter(places, lambda p: p.isNotNull())),
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).cast("bigint").alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("bigint"), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"])

    def counted(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(let(F.sort_array(marked), covered))

    windows = F.transform(F.slice(w, 1, F.size(w) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))
    return F.when(F.size(w) > WINDOW, let(windows, counted)).otherwise(F.lit(0).cast("bigint"))


def _long(c: Column) -> Column:
    return c.cast("bigint")


def measured(t: Column) -> Column:
    """A struct of the counts of text t."""
    stops = F.array(*[F.lit(f) for w in dict.fromkeys(STOP_WORDS) for f in dict.fromkeys((w, w.capitalize()))])

    def counts(w: Column) -> Column:
        return F.struct(
            _long(F.size(w)).alias("n_words"),
            _long(F.length(F.array_join(w, ""))).alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
            _long(F.size(F.array_intersect(w, stops))).alias("n_stop_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(_long(F.size(ls)).alias("n_lines"), _long(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))

    return F.struct(
        let(F.array_remove(F.split(t, SPACE), ""), counts).alias("w"),
        let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), of_lines).alias("l"),
        _long(F.regexp_count(t, F.lit(SYMBOL))).alias("n_symbols"),
        _long(F.regexp_count(t, F.lit("[!?]"))).alias("n_marks"),
        _long(F.regexp_count(t, F.lit("(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0Da-z]*[A-Z]{2}[^\\x20\\x09-\\x0Da-z]*(?![^\\x20\\x09-\\x0D])"))).alias("n_upper_words"))


def passes(rule: Rule) -> Column:
    part, whole = F.col(rule.part).cast("double"), F.col(rule.whole).cast("double")
    ok = F.lit(True)
    if rule.low is not None:
        ok &= part >= F.lit(float(rule.low)) * whole
    if rule.high is not None:
        ok &= part <= F.lit(float(rule.high)) * whole
    return (F.col("n_words") < rule.least) | ok


def rated(docs: DataFrame, rules: Sequence[Rule] = RULES, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """doc_id, the counts, base_failed, the rules that fail (`failed`), kept.

    base_failed: fewer than `least_words` words, or over `most_repeated` percent of them in repeated windows.
    """
    m = docs.select("doc_id", measured(text_of()).alias("m"))
    flat = m.select("doc_id", "m.w.*", "m.l.*", "m.n_symbols", "m.n_marks", "m.n_upper_words", F.lit(1).alias("one"))
    failing = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = flat.withColumns({"base_failed": base, "failed": failing})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.col("n_lines"), F.col("n_stop_words"),
                      F.array_join("failed", ",").alias("failed"))


def op10(spark, sf_dir: str) -> DataFrame:
    return rated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_rule(r: Rule) -> str:
    tests = [f"cast({r.part} AS double) >= {float(r.low)!r} * {r.whole}"] if r.low is not None else []
    tests += [f"cast({r.part} AS double) <= {float(r.high)!r} * {r.whole}"] if r.high is not None else []
    return f"CASE WHEN NOT (n_words < {r.least} OR ({' AND '.join(tests)})) THEN '{r.name}' END"


OP10_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 4), ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) > 5)),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY 1),
m AS (SELECT w.doc_id, cast(len(ws) AS bigint) AS n_words, cast(length(array_to_string(ws, '')) AS bigint) AS word_chars,
        cast(len(regexp_extract_all(x, '{SYMBOL}')) AS bigint) AS n_symbols, cast(len(regexp_extract_all(x, '[!?]')) AS bigint) AS n_marks,
        cast(len(list_filter(ws, lambda v: regexp_full_match(v, '[^\\x20\\x09-\\x0Da-z]*[A-Z]{{2}}[^\\x20\\x09-\\x0Da-z]*'))) AS bigint) AS n_upper_words,
        cast(len(list_intersect(ws, [{", ".join(f"'{f}'" for v in dict.fromkeys(STOP_WORDS) for f in dict.fromkeys((v, v.capitalize())))}])) AS bigint) AS n_stop_words,
        cast(len(ls) AS bigint) AS n_lines, cast(len(ls) - len(list_distinct(ls)) AS bigint) AS n_dup_lines,
        coalesce(rep.n_repeat_words, 0) AS n_repeat_words, 1 AS one
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        array_to_string(list_filter([{", ".join(_sql_rule(r) for r in RULES)}], lambda z: z IS NOT NULL), ',') AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept,
       n_lines, n_stop_words, failed FROM f
"""
