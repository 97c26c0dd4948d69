import hashlib
import random
import re

from tickloom.llm.secret_scan import BASE, RULES, redacted, scanned
from tickloom.llm.trigrams import TRUE, query_of, trigrams_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(t):
    s = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(s + [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32])


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_against_brute_force(spark):
    r = random.Random(2)
    parts = ["password", "PassWd", "token", "secret", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abcdefgh", "x1.-", "AKIA", "ABCDEFGHIJKL", "akia", "0" * 31, "0" * 32, "deadbeef", "é",
             "😀", "\n", "ſecret=", "toKen=", "ghp_" + "a" * 36, "eyJhbGciOi", ".eyJzdWIiOjE", ".abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "http://me:pw@host", "xoxb-1234567890"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(3000)] + [(-1, None), (-2, ""), (-3, "token=abcdefgh " * 300)]
    got = {x.doc_id: x for x in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    more = [re.compile(q.pattern) for q in RULES[len(BASE):]]
    for i, t in rows:
        want, t = brute(t or ""), t or ""
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3)), t
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        extra = [(m.start(), 3 + k, RULES[3 + k].kind, m.end()) for k, p in enumerate(more) for m in p.finditer(t)]
        assert got[i].spans == listed(sorted(want + extra))


def test_queries_of_rules():
    assert query_of(r"[0-9a-f]{32,}") is TRUE and query_of("a?b*") is TRUE
    assert query_of("abcd") == ("and", ("abc", "bcd"))
    assert query_of("(abc|xyz)+[0-9]") == ("or", ("abc", "xyz"))
    assert query_of("x(ab)?cd") == ("or", (("and", ("xab", "abc", "bcd")), "xcd"))
    assert trigrams_of(query_of("(?i)AB[cd]e")) == {"abc", "abd", "bce", "bde"}


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "a password=abcdefgh1 b", 5, "s"), (1, "a password=abcdefgh1 b", 5, "s"), (2, "clean", 5, "s"), (3, None, 5, "s"), (None, "é " + "0" * 40, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = redacted(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [(1, "a [assign] b", 12, "s"), (1, "a [assign] b", 12, "s"), (2, "clean", 5, "s"), (3, None, None, "s"), (None, "é [hex]", 7, None)], key=str)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert scanned(empty).count() == 0 and redacted(empty).count() == 0
