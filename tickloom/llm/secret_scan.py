"""Secrets in texts by rules, through a trigram inverted index. DataFrame functions only.

Each rule's expression is turned into a Boolean query of trigrams that every match holds. The index lists, for each trigram
that some rule asks for, the rows whose text holds it (in lower case). Postings are intersected to the candidate rows of
each rule; only these are searched with the expression. Rules without a mandatory trigram search all rows.

Matches are leftmost and non-overlapping for each kind; places count code points from 0, the end is exclusive. Null and
empty texts have no spans. Repeated rows give repeated results; other columns are kept or ignored as the function says.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .store import let, text_of, written
from .trigrams import TRUE, holds, query_of, trigrams_of


@dataclass(frozen=True)
class Rule:
    """least: characters that group `group` needs, or the match (group 0)."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Runs of AKIA.. of 16 characters and of hexadecimal digits of 32 start at the first place of the run, so their least length
#: can stand in the expression. An assignment that is too short still uses up its characters, so its length is tested after.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,100}:[^\x20\x09-\x0D/:@]{1,100}@"),
)
RULES = BASE + MORE


def index(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Postings: trigram, row (digest of doc_id and text)."""
    wanted = sorted(set().union(*[trigrams_of(query_of(r.pattern)) for r in rules]))
    low = docs.select(F.xxhash64("doc_id", text_of()).alias("row"), F.lower(text_of()).alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    return low.select("row", F.explode(there).alias("trigram")).select("trigram", "row")


def candidates(postings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """row, kinds: the rules whose query the row's postings fulfil; rows of none are left out."""
    present = postings.groupBy("row").agg(F.collect_set("trigram").alias("present"))  # at most the trigrams of the rules
    queries = [(r, query_of(r.pattern)) for r in rules]
    kinds = F.array_compact(F.array(*[F.when(holds(q, F.col("present")), F.lit(r.kind)) for r, q in queries if q is not TRUE]))
    return present.select("row", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule: the text between matches, and the matches, give the places."""
    def placed(z: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("spans"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + F.length(x["gap"])
            end = begin + F.length(x["match"])
            span = F.struct(begin.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
            ok = x["match"].isNotNull() & (F.length(x["part"]) >= rule.least)
            return F.struct(F.coalesce(end, begin).alias("at"), F.when(ok, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(z, start, step, lambda a: a["spans"])

    p = F.lit(rule.pattern)
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"),
                          F.regexp_extract_all(text, p, F.lit(rule.group)).alias("part"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # Most searched texts have no match; one search tells.
    return F.when(F.regexp_instr(text, p) > 0, let(zipped, placed)).otherwise(none)


def found(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with `spans`: array of (start, kind, end), ordered; kind is the number of the rule."""
    kinds = written(candidates(written(index(docs, rules), "postings"), rules), "candidates").select(F.col("row").alias("__row"), F.col("kinds").alias("__kinds"))
    j = docs.join(kinds, F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit(""))) == F.col("__row"), "left")
    text = F.coalesce(docs["text"], F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = [_spans(text, r, i) if query_of(r.pattern) is TRUE else
            F.when(F.array_contains(F.coalesce(F.col("__kinds"), F.array().cast("array<string>")), r.kind), _spans(text, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return j.select(*[docs[c] for c in docs.columns], F.sort_array(F.concat(*each)).alias("spans"))


def _listed(spans: Column, rules: Sequence[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256, spans, n_spans. The base rules come first in `rules`."""
    f = found(docs.select("doc_id", "text"), rules)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    of_kind = lambda i: F.filter("spans", lambda s: s["kind"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return f.select("doc_id", *counts, F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("spans"), rules).alias("spans"),
                    F.size("spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with all columns; every span in text is replaced by its kind in brackets, n_chars (where there is one) is counted anew.

    Of overlapping spans the first is named, and the text goes on behind the last of them. Texts without spans stay as they are.
    """
    names = F.array(*[F.lit(r.kind) for r in rules])
    plain = docs.withColumnRenamed("spans", "__spans") if "spans" in docs.columns else docs
    f = found(plain, rules)
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        before = F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], before).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    out = f.withColumn("text", F.when(F.size("spans") == 0, text).otherwise(clean)).drop("spans").withColumnsRenamed({"__spans": "spans"} if "spans" in docs.columns else {})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6(spark, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
