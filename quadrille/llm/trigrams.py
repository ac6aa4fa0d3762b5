"""Boolean trigram queries derived from regular expressions.

A query is a list of alternatives, each the set of trigrams that a text must hold, in lower
case, if the expression is to match by that alternative. An expression with an alternative
that needs no trigram has no query, and its rule reads every text.
"""

from __future__ import annotations

import re._parser as sre
from itertools import product

GAP = "\0"
MOST = 64


def _choices(node) -> list[str]:
    """Texts that a parsed node stands for, GAP where it can be anything or nothing; [GAP] if they are too many."""
    out = [""]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            part = [chr(arg).lower()]
        elif name == "IN":
            part = sorted({chr(x).lower() for kind, x in arg}) if len(arg) <= 8 and all(str(kind) == "LITERAL" for kind, _ in arg) else [GAP]
        elif name == "SUBPATTERN":
            part = _choices(arg[3])
        elif name == "BRANCH":
            part = [x for branch in arg[1] for x in _choices(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            once = _choices(inner)
            if int(high) == low and low <= 8 and len(once) ** low <= MOST:
                part = ["".join(x) for x in product(once, repeat=low)]
            elif low == 0 and int(high) == 1:
                part = ["", *once]
            else:
                part = [x + GAP for x in once] if low else [GAP]
        elif name == "AT":
            part = [""]
        else:
            part = [GAP]
        part = list(dict.fromkeys(part))
        out = [a + b for a in out for b in part] if len(out) * len(part) <= MOST else [a + GAP for a in out]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams; empty if some alternative has none. Alternatives that another one contains are left out."""
    ways = []
    for text in _choices(sre.parse(pattern)):
        ways.append(frozenset(run[i : i + 3] for run in text.split(GAP) for i in range(len(run) - 2)))
    if not all(ways):
        return []
    return sorted({w for w in ways if not any(o < w for o in ways)}, key=sorted)
