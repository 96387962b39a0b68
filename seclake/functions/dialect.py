"""Regular expressions are stored in ECMAScript notation; this turns them into Java's.

Differences that change results and are handled here: `\\s` covers Unicode blanks, `.` stops only
at four line terminators, `$` is the end of input (not "before a last line break"), `[` and `&&`
inside a class are ordinary characters, word edges see ASCII word characters only, and case folding
is ASCII unless the pattern holds other letters.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.model import Pattern, Rx

BLANKS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: An edge between a word character and another one, ASCII only.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_DOT = r"[^\n\r\u2028\u2029]"
_SPECIAL = set("\\^$.|?*+()[]{}")


def quote(literal: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in literal)


@lru_cache(maxsize=None)
def java_regex(pattern: Pattern) -> str:
    if isinstance(pattern, str):
        return "(?iu)" + quote(pattern)
    return _flags(pattern) + _body(pattern)


def _flags(p: Rx) -> str:
    on = ""
    if "i" in p.flags:
        on += "i" if p.text.isascii() else "iu"
    if "m" in p.flags:
        on += "m"
    return f"(?{on})" if on else ""


def _body(p: Rx) -> str:
    out, i, in_class, text = [], 0, False, p.text
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            pair = text[i : i + 2]
            if pair == r"\s":
                out.append(BLANKS if in_class else f"[{BLANKS}]")
            elif pair == r"\S" and not in_class:
                out.append(f"[^{BLANKS}]")
            elif pair == r"\b" and not in_class:
                out.append(_edge(text[i + 2 : i + 3]))
            else:
                out.append(pair)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            if text[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == ".":
            out.append(_DOT)
        elif c == "$" and "m" not in p.flags:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _edge(after: str) -> str:
    """Java 17's word edge knows all letters, ECMAScript's only ASCII word characters."""
    if after.isalnum() and after.isascii():
        return r"(?<!\w)"
    return EDGE


@lru_cache(maxsize=None)
def linear_guard(pattern: Pattern) -> str | None:
    """What any text with a match of the pattern matches, too, told in one pass over the text; None where there is nothing to spare.

    A pattern of pieces with `.*` between them tries every later piece again after each place of the first, which on a long line with
    many of these places takes quadratic time. In a match the pieces start one after the other, so that the first start of each
    piece from that of the piece before exists and comes no later; these starts are found without going back.
    """
    if isinstance(pattern, str) or re.search(r"\\[1-9k]", pattern.text):
        return None
    body, pieces, start, at, depth, in_class = _body(pattern), [], 0, 0, 0, False
    while at < len(body):
        c = body[at]
        if depth == 0 and not in_class and body.startswith(_DOT, at) and body[at + len(_DOT) : at + len(_DOT) + 1] in ("*", "+"):
            pieces.append(body[start:at])
            at += len(_DOT) + 1
            at += body[at : at + 1] in ("?", "+")
            start = at
            continue
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return None
        at += 1
    pieces = [p for p in [*pieces, body[start:]] if p]
    return _flags(pattern) + r"\A" + "".join(rf"(?>(?s:.*?)(?={p}))" for p in pieces) if len(pieces) > 1 else None


def trimmed(text: Column) -> Column:
    """Without blanks at both ends, Unicode ones too."""
    return F.regexp_replace(text, rf"\A[{BLANKS}]++|[{BLANKS}]++\z", "")


def any_of(patterns: list[Pattern]) -> str | None:
    """One Java expression that matches where any of the patterns does (presence only)."""
    if not patterns:
        return None
    parts = []
    for p in patterns:
        j = java_regex(p)
        if j.startswith("(?") and j[2] in "im":
            flags, body = j[2:].split(")", 1)
            parts.append(f"(?{flags}:{body})")
        else:
            parts.append(f"(?:{j})")
    return "|".join(parts)
