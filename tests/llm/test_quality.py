import random
import re

from tickloom.llm.quality import rated


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_counts_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(["a", "b", "cé", "#", "😀", " ", " ", "\n", "\t", "\x0b", "\x1c", " ", "a b a b a "]) for _ in range(r.randint(0, 60)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "x " * 3000), (904, "w1 w2 w3 w4 w5"), (904, "w1 w2 w3 w4 w5")]
    got = {}
    for x in rated(spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_words long, kept string")).collect():
        got.setdefault(x.doc_id, []).append(x)
    for i, t in rows:
        for x in got[i]:
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(t), t
            assert not (x.base_failed and x.kept)
    assert len(got[904]) == 2


def test_rules(spark):
    clean = "the quick brown fox and the lazy dog met near a small river to talk about weather in that town"
    rows = [(1, clean), (2, clean.upper()), (3, clean.replace(" ", " # ")), (4, clean.replace(" ", "!! ")), (5, "\n".join([clean.replace("dog", "dog#")] * 1))]
    got = {x.doc_id: (x.kept, x.failed) for x in rated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (True, "") and got[2] == (False, "upper_words") and got[3][0] is False and got[4] == (False, "marks_per_word") and got[5][0]


def test_plan_has_no_python(spark):
    plan = rated(spark.createDataFrame([], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
