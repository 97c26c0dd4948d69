"""A lexicon trie intersected with Levenshtein automata.

A term is a whole word or a stem (any ending may follow). All terms lie in one trie. The automaton reads a word and holds
the set of (trie node, edits so far) that its Levenshtein automata can be in; the sets met so far are kept as states of a
deterministic automaton, so most words die after a few table look-ups.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from math import log

END = "$"
#: Characters that may stand inside a word or for a letter, such as in "id!ot"; others are cut from its ends.
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool

    @property
    def edits(self) -> int:
        """Edits that a misspelling may have."""
        return 0 if len(self.text) < 5 else 1 if len(self.text) < 9 else 2


def bare(word: str) -> str:
    return _OUTER.sub("", word)


class Matcher:
    """Terms in a word, each with the fewest edits: `hits` gives a tuple of (number of the term, edits)."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, t in enumerate(terms):
            node = 0
            for c in t.text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                node = self.child[node][c]
            self.ends[node].append(k)
        # No misspelling of a subtree needs more edits than its terms allow.
        self.most = [0] * len(self.child)
        for t in terms:
            node = 0
            for c in t.text:
                self.most[node] = max(self.most[node], t.edits)
                node = self.child[node][c]
            self.most[node] = max(self.most[node], t.edits)
        self.alphabet = {c for d in self.child for c in d}
        self.state_of: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.open_hits: list[tuple] = []
        self.end_hits: list[tuple] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        work = list(items)
        while work:  # letters of a term that the word lacks
            node, e = work.pop()
            if e < self.most[node]:
                for n in self.child[node].values():
                    if (n, e + 1) not in items:
                        items.add((n, e + 1))
                        work.append((n, e + 1))
        low: dict[int, int] = {}
        for node, e in items:
            low[node] = min(e, low.get(node, 9))
        key = frozenset(low.items())
        if key not in self.state_of:
            self.state_of[key] = len(self.items)
            self.items.append(key)
            self.step.append({})
            hits = [(k, e) for node, e in key for k in self.ends[node] if e <= self.terms[k].edits]
            self.open_hits.append(tuple(h for h in hits if self.terms[h[0]].stem))
            self.end_hits.append(tuple(hits))
        return self.state_of[key]

    def _next(self, state: int, c: str) -> int:
        new = set()
        for node, e in self.items[state]:
            if c in self.child[node]:
                new.add((self.child[node][c], e))
            if e < self.most[node]:
                new.add((node, e + 1))
                new.update((n, e + 1) for n in self.child[node].values())
        out = self._state(new)
        self.step[state][c] = out
        return out

    def hits(self, word: str) -> tuple[tuple[int, int], ...]:
        state, found, other = self.start, None, self.alphabet
        for c in word:
            if c not in other:
                c = END  # all letters beyond the lexicon are alike
            nxt = self.step[state].get(c)
            state = self._next(state, c) if nxt is None else nxt
            if not self.items[state]:
                break
            if self.open_hits[state]:
                found = (found or []) + list(self.open_hits[state])
        else:
            if self.end_hits[state]:
                found = (found or []) + list(self.end_hits[state])
        if not found:
            return ()
        best: dict[int, int] = {}
        for k, e in found:
            best[k] = min(e, best.get(k, 9))
        return tuple(sorted(best.items()))


def likelihood(b: int, g: int, n_bad: int, n_good: int) -> float:
    """Log-likelihood ratio of b of n_bad texts and g of n_good texts against one common rate."""
    part = lambda k, n, p: (k * log(k / (n * p)) if k else 0.0) + ((n - k) * log((n - k) / (n * (1 - p))) if n > k else 0.0)
    p = (b + g) / (n_bad + n_good)
    return 2 * (part(b, n_bad, p) + part(g, n_good, p)) if 0 < p < 1 else 0.0


def chosen(prefixes: dict[str, tuple[int, int, int, int]], n_bad: int, n_good: int, support: int, odds: float = 4.0, least_g: float = 25.0) -> list[Term]:
    """Terms from counts of word beginnings, whole words with END behind: bad and good texts with one, and with two or more.

    The beginning that tells bad from good texts best (log-likelihood ratio of either pair of counts) comes first; it is
    lengthened as long as nearly all its bad texts stay, and then stands for all beginnings that start it or start with it.
    `support` bad texts and `odds` times the rate of good ones are needed; every term that passes is taken, so the lexicon is
    bounded by the sample alone.
    """
    def weight(b: int, g: int) -> float:
        return likelihood(b, g, n_bad, n_good) if b >= support and b / n_bad >= odds * (g + 0.5) / n_good else 0.0

    rest = {p: max(weight(*c[:2]), weight(*c[2:])) for p, c in prefixes.items()}
    rest = {p: x for p, x in rest.items() if x >= least_g}
    below: dict[str, list[str]] = {}
    for p in prefixes:
        below.setdefault(p[:-1], []).append(p)
    out, taken = [], set()
    for p in sorted(rest, key=lambda p: (-rest[p], len(p), p)):
        if p in taken or any(p.startswith(t) for t in out):
            continue
        while not p.endswith(END):
            more = [c for c in below.get(p, ()) if prefixes[c][0] >= 0.9 * prefixes[p][0]]
            if not more:
                break
            p = more[0]
        out.append(p)
        taken.update(p[:i] for i in range(1, len(p) + 1))
    return sorted((Term(p.removesuffix(END), not p.endswith(END)) for p in out), key=lambda t: (t.text, t.stem))
