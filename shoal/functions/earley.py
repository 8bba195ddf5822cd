"""Weighted context-free parsing by Earley's algorithm, keeping the highest-scoring derivation.

A grammar is written as text, one nonterminal a line:

    NAME -> symbol symbol ... [weight] | symbol ... [weight]

Symbols in capitals are nonterminals, everything else is a terminal (a lexeme class). A terminal
may carry a field name, ``class:field``; tokens taken through it are reported under that name.
The weight of a derivation is the sum of the weights of its rules (0 where none is written).
An empty right-hand side is written as ``<empty>``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence


class Grammar:
    """Rules by nonterminal; ``start`` is the first one written."""

    def __init__(self, text: str):
        self.rules: dict[str, list[tuple[tuple[str, ...], float]]] = {}
        self.start = ""
        for line in text.strip().splitlines():
            line = line.strip()
            if not line or line.startswith("//"):
                continue
            name, body = (x.strip() for x in line.split("->", 1))
            self.start = self.start or name
            for alt in body.split(" | "):
                weight = 0.0
                if m := re.search(r"\s\[(-?[\d.]+)\]$", " " + alt.strip()):
                    weight, alt = float(m[1]), (" " + alt.strip())[: m.start()]
                symbols = tuple(s for s in alt.split() if s != "<empty>")
                self.rules.setdefault(name, []).append((symbols, weight))
        self.nullable = self._nullable()

    def _nullable(self) -> dict[str, float]:
        """Best weight at which a nonterminal derives nothing."""
        best: dict[str, float] = {}
        changed = True
        while changed:
            changed = False
            for name, alts in self.rules.items():
                for symbols, w in alts:
                    if all(s in best for s in symbols):
                        total = w + sum(best[s] for s in symbols)
                        if total > best.get(name, float("-inf")):
                            best[name] = total
                            changed = True
        return best

    def is_rule(self, symbol: str) -> bool:
        return symbol in self.rules


class Parse:
    """The best derivation: its score and the (field, token index) pairs in order; or how far it got."""

    __slots__ = ("fields", "reached", "score")

    def __init__(self, score: float | None, fields: tuple[tuple[str, int], ...], reached: int):
        self.score, self.fields, self.reached = score, fields, reached

    @property
    def ok(self) -> bool:
        return self.score is not None


def parse(grammar: Grammar, tokens: Sequence[str]) -> Parse:
    """Earley recognition with best-score bookkeeping over a sequence of lexeme classes.

    ``reached`` is the number of leading tokens that some derivation explains: the unparsed span
    starts there. Ties in score go to the rule written first.
    """
    n = len(tokens)
    rules = grammar.rules
    # an item is (nonterminal, alternative, dot, origin); its value (score, fields so far as a linked list)
    chart: list[dict[tuple, tuple]] = [{} for _ in range(n + 1)]
    waiting: list[dict[str, list[tuple]]] = [{} for _ in range(n + 1)]

    def flat(link) -> tuple:
        out = []

        def walk(x):
            stack = [x]
            while stack:
                y = stack.pop()
                if y is None:
                    continue
                if y[0] == "cat":
                    stack.append(y[1])
                    stack.append(y[2])
                else:
                    out.append((y[1], y[2]))

        walk(link)
        out.reverse()
        return tuple(out)

    def add(k: int, item: tuple, score: float, link, agenda: list) -> None:
        old = chart[k].get(item)
        if old is None or score > old[0] + 1e-12:
            chart[k][item] = (score, link)
            agenda.append(item)

    agenda: list = []
    for a in range(len(rules[grammar.start])):
        add(0, (grammar.start, a, 0, 0), rules[grammar.start][a][1], None, agenda)
    reached = 0
    for k in range(n + 1):
        nxt: list = []
        done_at: dict[tuple[str, int], tuple] = {}
        while agenda:
            item = agenda.pop()
            name, alt, dot, origin = item
            score, link = chart[k][item]
            symbols = rules[name][alt][0]
            if dot < len(symbols):
                sym = symbols[dot]
                if sym in rules:
                    lst = waiting[k].setdefault(sym, [])
                    if item not in lst:
                        lst.append(item)
                        for a in range(len(rules[sym])):
                            add(k, (sym, a, 0, k), rules[sym][a][1], None, agenda)
                    if sym in grammar.nullable:
                        add(k, (name, alt, dot + 1, origin), score + grammar.nullable[sym], link, agenda)
                    got = done_at.get((sym, k))
                    if got:
                        add(k, (name, alt, dot + 1, origin), score + got[0], _cat(link, got[1]), agenda)
                elif k < n:
                    cls, _, field = sym.partition(":")
                    if tokens[k] == cls:
                        new = _cat(link, ("tok", field, k)) if field else link
                        i2 = (name, alt, dot + 1, origin)
                        old = chart[k + 1].get(i2)
                        if old is None or score > old[0] + 1e-12:
                            chart[k + 1][i2] = (score, new)
                            if old is None:
                                nxt.append(i2)
            else:
                best = done_at.get((name, origin))
                if best is None or score > best[0] + 1e-12:
                    done_at[(name, origin)] = (score, link)
                    if origin != k:
                        for up in list(waiting[origin].get(name, ())):
                            us, ul = chart[origin][up]
                            add(k, (up[0], up[1], up[2] + 1, up[3]), us + score, _cat(ul, link), agenda)
        if chart[k]:
            reached = k
        if k < n and not nxt:
            break
        agenda = nxt
    best = None
    if reached == n:
        for a, (symbols, _) in enumerate(rules[grammar.start]):
            got = chart[n].get((grammar.start, a, len(symbols), 0))
            if got and (best is None or got[0] > best[0]):
                best = got
    return Parse(best[0], flat(best[1]), n) if best else Parse(None, (), reached)


def _cat(a, b):
    if a is None:
        return b
    if b is None:
        return a
    return ("cat", a, b)
