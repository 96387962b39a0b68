"""Which fixed strings must a line hold before a rule can match it?

`required(pattern)` gives a set of lower-cased strings of which every match contains at least one,
or None where no useful set exists. The sets feed one prefilter expression for the whole catalogue,
so that most lines never meet a rule.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from re import _constants as c
from re import _parser

from ..rules.model import Pattern

_MAX_SET = 48
_MAX_CLASS = 6


@lru_cache(maxsize=None)
def required(pattern: Pattern) -> frozenset[str] | None:
    if isinstance(pattern, str):
        return frozenset({pattern.lower()})
    exact, need = _sequence(_parser.parse(pattern.text))
    best = _better(exact, need)
    return frozenset(best) if best else None


def _usable(s: set[str] | None) -> bool:
    return bool(s) and min(map(len, s)) >= 2


def _score(s: set[str]) -> tuple[int, int]:
    return (min(8, min(map(len, s))), -len(s))


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if not _usable(a):
        return b if _usable(b) else None
    if not _usable(b):
        return a
    return a if _score(a) >= _score(b) else b


def _sequence(items) -> tuple[set[str] | None, set[str] | None]:
    """(all strings the sequence can be, if few; best required set seen inside it)."""
    run: set[str] = {""}
    whole, need = True, None
    for op, arg in items:
        exact, inner = _node(op, arg)
        need = _better(need, inner)
        if exact is not None and len(run) * len(exact) <= _MAX_SET:
            run = {a + b for a, b in product(run, exact)}
            continue
        need = _better(need, run)
        run, whole = (exact, False) if exact is not None else ({""}, False)
    return (run, need) if whole else (None, _better(need, run))


def _node(op, arg) -> tuple[set[str] | None, set[str] | None]:
    if op is c.LITERAL:
        return {chr(arg).lower()}, None
    if op is c.IN:
        chars: set[str] = set()
        for kind, v in arg:
            if kind is c.LITERAL:
                chars.add(chr(v).lower())
            elif kind is c.RANGE and v[1] - v[0] < _MAX_CLASS:
                chars |= {chr(x).lower() for x in range(v[0], v[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= _MAX_CLASS else (None, None)
    if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
        return {""}, None
    if op is c.SUBPATTERN:
        return _sequence(arg[3])
    if op is c.BRANCH:
        exacts, needs = [], []
        for branch in arg[1]:
            e, n = _sequence(branch)
            exacts.append(e)
            needs.append(_better(e, n))
        union = None
        if all(n is not None for n in needs):
            union = set().union(*needs)
        if all(e is not None for e in exacts):
            return set().union(*exacts), union
        return None, union
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        low, high, body = arg
        e, n = _sequence(body)
        if low == 0:
            return ({""} | e, None) if high == 1 and e is not None else (None, None)
        if e is not None and low == high and len(e) ** low <= _MAX_SET:
            return {"".join(t) for t in product(e, repeat=low)}, None
        return None, _better(e, n)
    return None, None
