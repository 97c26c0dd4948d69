import os
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import line_dedup
from tickloom.llm.line_dedup import Bound, line_report, without_repeated_lines

WIDE = "doc_id long, text string, lang string, n_chars long, a long, line string, dropped string"


def near(x, y):
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) > len(y):
        x, y = y, x
    i = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    return x[i + 1:] == y[i + 1:] if len(x) == len(y) else x[i:] == y[i + 1:]


def brute(rows, least):
    """rows of (doc_id, text) with distinct doc_ids."""
    seen, out = [], {}
    for d, t in sorted(rows):
        ls = t.split("\n")
        gone = []
        for i, x in enumerate(ls):
            x = x.strip(" \t\r")
            if len(x) >= least:
                if any(near(x, y) for y in seen):
                    gone.append(i)
                seen.append(x)
        out[d] = gone
    return out


def edit(r, x):
    k, c = r.randrange(len(x)), r.choice("xyzé漢😀")
    return r.choice([x[:k] + x[k + 1:], x[:k] + c + x[k + 1:], x[:k] + c + x[k:], x + c, c + x, x[1:], x[:-1], x])


def test_against_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcde é") for _ in range(r.choice([24, 25, 30, 63, 64, 65, 80, 127, 128, 200]))).strip() + "q" * 24 for _ in range(12)]
    rows = []
    for d in range(60):
        ls = [edit(r, r.choice(base)) for _ in range(r.randint(1, 4))]
        if r.random() < 0.5:
            ls.append(edit(r, edit(r, r.choice(base))))
        rows.append((d, "\n".join([*ls, "short", ""])))
    got = {x.doc_id: [int(i) for i in x.dropped.split(",") if i] for x in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 24)


def test_text_is_rebuilt_with_all_columns(spark):
    x = "a line that is long enough to count"
    rows = [(1, f"{x}\nkept\n{x}", "en", 1, 7, "l", "d"), (2, x, "en", 1, 7, "l", "d"), (3, f"  {x}!\nend", None, None, None, None, None),
            (4, None, "en", 0, 1, "", ""), (5, "", "en", 0, 1, "", ""), (None, f"{x}\nz", "en", 0, 1, "", "")]
    out = without_repeated_lines(spark.createDataFrame(rows, WIDE))
    assert out.schema.simpleString() == spark.createDataFrame([], WIDE).schema.simpleString()
    got = {r.doc_id: (r.text, r.n_chars, r.a) for r in out.collect()}
    assert got == {1: (f"{x}\nkept", len(x) + 5, 7), 2: ("", 0, 7), 3: ("end", 3, None), 4: (None, None, 1), 5: ("", 0, 1), None: ("z", 1, 1)}


def test_nulls_ties_repeated_rows_and_no_rows(spark):
    x = "the very same line of text in all rows"
    rows = [(1, x), (1, x), (1, f"{x}\n{x}"), (2, x), (None, x), (None, None), (3, None)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # Equal rows are one document; of the two texts of document 1 the one with the lower digest comes first.
    assert sum(r[2] for r in got if r[0] == "1") in (2, 3) and ("2", 1, 1) in got and ("None", 1, 1) in got and ("None", 0, 0) in got and ("3", 0, 0) in got
    assert line_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_line(spark):
    x = "one line that half of all documents share, word for word"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(x)).otherwise(F.concat(F.lit("a line of its own, number "), F.col("id") * 100)).alias("text"))
    assert line_report(docs).agg(F.sum("n_dropped")).first()[0] >= 1499


def test_short_lines_go_where_they_repeat(spark):
    rows = [(1, "Les.\n\nLes.\na"), (2, " Les.\nLes\na\n\n"), (3, "Les."), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.dropped) for r in line_report(docs, equal=1).collect()} == {1: (3, "2"), 2: (3, "0,2"), 3: (1, "0"), 4: (0, "")}
    assert {r.doc_id: r.text for r in without_repeated_lines(docs).collect()} == {1: "Les.\n\na", 2: "Les\n\n", 3: "", 4: None}


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x):
        last, row = row, [i + 1]
        for j, q in enumerate(y):
            row.append(min(last[j] + (p != q), last[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.mark.parametrize("small,family", [(64, 2048), (2, 5)])
def test_bound_that_grows_against_brute_force(spark, monkeypatch, small, family):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "FAMILY", family)
    r, bound, rows = random.Random(7), Bound(per=30, most=5), []
    base = ["".join(r.choice("abcdé😀") for _ in range(r.choice([24, 28, 29, 30, 31, 59, 61, 90, 119, 121, 160]))) for _ in range(8)]
    for d in range(70):
        x = r.choice(base)
        for _ in range(r.randrange(7)):
            x = edit(r, x)
        rows.append((d, x))
    got = {x.doc_id: x.n_dropped for x in line_report(spark.createDataFrame(rows, "doc_id long, text string"), bound=bound).collect()}
    long = [(d, x) for d, x in rows if len(x) >= 24]
    want = {d: int(any(e < d and distance(x, y) <= bound.of(max(len(x), len(y))) for e, y in long)) if (d, x) in long else 0 for d, x in rows}
    assert got == want and 10 < sum(want.values()) < 65


def test_a_line_with_two_typos_goes_in_the_pipeline(spark):
    x = "a sentence of more than fifty characters that stands in one document and, with typos, in another"
    rows = [(1, x), (2, x.replace("sentence", "sentense").replace("typos", "tipos")), (3, x.replace("document", "book"))]
    assert [r.text for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [x, "", rows[2][1]]


def test_registered_query_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    base = ["".join(r.choice("abc é") for _ in range(n)).strip() + "q" for n in (2, 5, 22, 23, 24, 25, 40, 65)]
    rows = [(d, "\n".join([*[edit(r, r.choice(base)) for _ in range(4)], "", " Les. "])) for d in range(40)] + [(90, None), (91, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first, want = {}, {}
    for d, t in rows:
        ls = [x.strip(" \t\r") for x in (t or "").split("\n")]
        want[d] = (sum(x != "" for x in ls), [])
        for i, x in enumerate(ls):
            if x and (x in first or len(x) >= 24 and any(len(y) >= 24 and near(x, y) for y in first)):
                want[d][1].append(i)
            if x:
                first.setdefault(x, (d, i))
    got = {x.doc_id: (x.n_lines, [int(i) for i in x.dropped.split(",") if i]) for x in line_dedup.op2(spark, str(tmp_path)).collect()}
    assert got == want


def test_tables_on_the_way_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    x = "the quick brown fox jumps over the lazy dog " * 4
    docs = spark.createDataFrame([(1, x + "one"), (2, x + "two"), (None, x + "one"), (3, x + "one\nother")], "doc_id long, text string")
    before = set(os.listdir(folder))
    out = without_repeated_lines(docs)
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["gone"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: x + "one", 2: "", 3: "other", None: ""}


def test_earliest_line_of_a_run_is_not_compared_twice(spark, monkeypatch):
    r, rows = random.Random(5), {}
    tail = lambda: "".join(r.choice("abcdefghij ") for _ in range(60))
    head = tail() + tail()
    lines = [head + "x" + tail() + "y" for _ in range(2)]  # too far apart, with a run in common
    counted = lambda df, name, f=line_dedup.written: (f(df, name), rows.setdefault(name, df.count()))[0]
    monkeypatch.setattr(line_dedup, "written", counted)
    out = without_repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {x.doc_id: x.text for x in out.collect()} == dict(enumerate(lines))
    assert rows["runs"] and rows["lines"] == 2 and rows["pairs"] == 0


def test_lines_of_a_small_run_are_not_paired_before_they_are_near(spark, monkeypatch):
    r, rows = random.Random(6), {}
    tail = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    heads = [tail(120) for _ in range(3)]
    lines = [h + "x" + tail(60) + "y" for h in heads for _ in range(40)]  # three runs of lines too far apart
    near = [x[:150] + "zz" + x[152:] for x in lines[10:15]]
    counted = lambda df, name, f=line_dedup.written: (f(df, name), rows.setdefault(name, df.count()))[0]
    monkeypatch.setattr(line_dedup, "written", counted)
    out = without_repeated_lines(spark.createDataFrame(list(enumerate(lines + near)), "doc_id long, text string"))
    assert {x.doc_id: x.text for x in out.collect()} == dict(enumerate(lines + [""] * 5))
    assert rows["pairs"] <= 5
