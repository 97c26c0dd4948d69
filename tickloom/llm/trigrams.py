"""Boolean trigram queries of regular expressions, as in code search by a trigram index.

A query is TRUE (the expression demands no trigram), a trigram, ("and", queries) or ("or", queries). Every text that holds a
match fulfils the query; texts are looked at in lower case.
"""
from __future__ import annotations

from itertools import product
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, functions as F

TRUE = True
MOST_STRINGS = 40  # exact strings that are kept apart


def _join(kind: str, parts: list):
    if kind == "or" and TRUE in parts:
        return TRUE
    parts = [p for p in parts if p is not TRUE]
    flat = [q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == kind else [p])]
    flat = list(dict.fromkeys(flat))
    if kind == "or":  # a part that demands all that another one does, and more, adds nothing
        needs = [set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in flat]
        flat = [p for p, a in zip(flat, needs) if not any(b < a for b in needs)]
    if not flat:
        return TRUE
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]):
    """What a text holds that holds one of the strings."""
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings the items can match, if they are few, else None; the query)."""
    exact, found = {""}, []

    def flush() -> None:
        nonlocal exact
        found.append(_of_strings(exact))
        exact = {""}

    for op, arg in items:
        if op in (C.LITERAL,):
            here, q = {chr(arg).lower()}, TRUE
        elif op is C.IN and all(o is C.LITERAL or o is C.RANGE and a[1] - a[0] < 12 for o, a in arg):
            here, q = {chr(c).lower() for o, a in arg for c in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))}, TRUE
        elif op is C.SUBPATTERN:
            here, q = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            here = set().union(*[p[0] for p in parts]) if all(p[0] is not None for p in parts) else None
            q = _join("or", [_of_strings(p[0]) if p[0] is not None else p[1] for p in parts]) if here is None else TRUE
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            once, q = _walk(body)
            if (low, high) == (0, 1) and once is not None:
                here, q = once | {""}, TRUE
            elif low == high == 1:
                here = once
            else:
                here, q = None, TRUE if not low else (_of_strings(once) if once is not None else q)
                if low and once is not None and len(once) == 1:  # a fixed string, repeated
                    q = _of_strings({next(iter(once)) * low})
        elif op is C.AT:
            here, q = {""}, TRUE
        else:
            here, q = None, TRUE
        if here is None or len(here) * len(exact) > MOST_STRINGS:
            flush()
            found.append(q)
            if here is not None:
                exact = here if len(here) <= MOST_STRINGS else {""}
        else:
            exact = {a + b for a, b in product(exact, here)}
    if not found:
        return exact, TRUE
    flush()
    return None, _join("and", found)


def query_of(pattern: str):
    exact, q = _walk(parser.parse(pattern))
    return _of_strings(exact) if exact is not None else q


def trigrams_of(q) -> set[str]:
    return set() if q is TRUE else {q} if isinstance(q, str) else set().union(*map(trigrams_of, q[1]))


def holds(q, present: Column) -> Column:
    """Whether a set of trigrams fulfils the query."""
    if q is TRUE:
        return F.lit(True)
    if isinstance(q, str):
        return F.array_contains(present, q)
    parts = [holds(p, present) for p in q[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if q[0] == "and" else out | p
    return out
