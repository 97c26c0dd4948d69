import random

from tickloom.llm.lexicon import Matcher, Term
from tickloom.llm.toxicity import Finder, learned, rated, without_toxic


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
        p = q
    return p


def test_automaton_against_edit_distances():
    terms = [Term("idiot", False), Term("lowei", True), Term("disgusting", False), Term("scum", False), Term("vequ", True), Term("scumbags", False)]
    m, r = Matcher(terms), random.Random(3)
    for _ in range(8000):
        w = list(r.choice(terms).text)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(w) + 1)
            w[k:k + r.randint(0, 1)] = r.choice(["", "a", "e", "i", "1", "é"])
        w = "".join(w) + r.choice(["", "", "abc"])
        want = [(k, min(d) if t.stem else d[-1]) for k, t in enumerate(terms) for d in [distance(t.text, w)]]
        assert m.hits(w) == tuple((k, e) for k, e in want if e <= terms[k].edits), w


def test_contexts():
    f = Finder([Term("idiot", False)])
    def kinds(t):
        out = {}
        for (_, _, context), n in f(t).items():
            out[context] = out.get(context, 0) + n
        return out

    assert kinds('the word "idiot" is old') == {"quoted": 1} and kinds("she said idiot twice") == {"quoted": 1} and kinds("«idiot»") == {"quoted": 1}
    assert kinds("you are an idiot") == {"addressed": 1} and kinds("what an idiot! idi0t") == {"plain": 2} and kinds("nothing here") == {}


def corpus():
    r = random.Random(9)
    words = ["".join(r.choice("abdeilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(900)]
    bad = ["scoundrel", "nitwit", "blockhead"]
    docs, labels = [], []
    for i in range(1500):
        t = [r.choice(words) for _ in range(r.randint(20, 80))]
        y = int(r.random() < 0.15)
        if y:
            for _ in range(r.randint(2, 4)):
                w = r.choice(bad)
                if r.random() < 0.2:
                    k = r.randrange(len(w))
                    w = w[:k] + "x" + w[k + 1:]
                t.insert(r.randrange(len(t)), w)
        elif r.random() < 0.3:
            t.insert(5, f'said "{r.choice(bad)}"')  # quotations in clean texts
        docs.append((i, " ".join(t), r.choice(["en", "de"]), 1.0, "l"))
        if i % 2 == 0:
            labels.append((i, y, y))
    return docs, labels


def test_held_out_rows_and_columns(spark):
    docs, labels = corpus()
    extra = [(5000, None, None, None, None), (5001, "", "en", 1.0, ""), (None, "text", "en", 1.0, ""), (0, *docs[0][1:]), (5002, "nitwit blockhead " * 5000, "en", 0.0, "")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, score double, y string")
    lab = spark.createDataFrame(labels + [(2, None, 0), (None, 1, 1), (4, 0, None)], "doc_id long, toxic int, quality int")
    got = rated(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    by = {x.doc_id: x for x in got}
    truth = {i: y for i, _, y in labels}
    held = [i for i in truth if by[i].held_out]
    assert 100 < len(held) < 200 and sum(by[i].predicted == truth[i] for i in held) >= 0.96 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert by[5000].predicted == by[5001].predicted == 0 and by[5002].predicted == 1
    left = without_toxic(d, lab)
    assert left.columns == d.columns and left.count() == sum(1 - x.predicted for x in got)


def test_no_labels_and_no_rows(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.predicted for x in rated(d, none).collect()] == [0, 0] and without_toxic(d, none).count() == 2
    assert rated(d.limit(0), none).count() == 0


def test_rare_and_long_terms_are_learned(spark):
    """Abuse spread over 80 words, each in about 1% of the toxic texts, one of them longer than any beginning that is counted."""
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    common = ["".join(r.choices(letters, k=6)) for _ in range(300)]
    rare = ["".join(r.choices(letters, k=9)) for _ in range(79)] + ["donaudampfschifffahrtsgesellschaftslump"]
    rows = []
    for i in range(6400):
        words = r.choices(common, k=25)
        if i % 8 == 0:
            words[7] = words[20] = rare[i // 8 % 80]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(6400)], "doc_id long, toxic int")
    starts = [t.text for t in learned(docs, labels).terms]
    assert sum(any(w.startswith(s) for s in starts) for w in rare) >= 70 and any(rare[-1].startswith(s) for s in starts)
    got = rated(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
