"""Where the functions of a file end, for all of them in one sweep over its braces.

What leaves the JVM of a text is its braces and line ends; numbers of ranges come back. The running depth of a file is a
prefix sum. A function that opens at depth d closes at the first closing brace after its opening one that brings the
depth back to d, so closing braces sorted by (depth, position) answer every head by one binary search. The
work grows with the file, not with its functions times its length.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OTHER = re.compile(r"[^{}\n]+")
RANGES = "array<struct<start:int,stop:int,first:int,count:int>>"


def closing_lines(marks: str, heads: np.ndarray) -> np.ndarray:
    """The line on which the function of each head line closes, -1 if it does not. `marks` are braces and line feeds."""
    codes = np.frombuffer(marks.encode("ascii"), np.uint8)
    breaks = codes == 10
    at = np.flatnonzero(~breaks)
    line = np.cumsum(breaks)[at]
    opens = codes[at] == ord("{")
    depth = np.cumsum(np.where(opens, 1, -1))
    out = np.full(len(heads), -1, np.int64)
    openings, closings = np.flatnonzero(opens), np.flatnonzero(~opens)
    if not len(openings) or not len(closings):
        return out
    width = len(at) + 1
    order = closings[np.argsort(depth[closings], kind="stable")]
    keys = depth[order] * width + order
    before = np.searchsorted(line, heads, "left")  # braces on earlier lines
    base = np.where(before > 0, depth[before - 1], 0)
    opening = np.searchsorted(openings, before, "left")
    opened = np.flatnonzero(opening < len(openings))
    found = np.searchsorted(keys, base[opened] * width + openings[opening[opened]], "right")
    held = opened[found < len(keys)]
    place = found[found < len(keys)]
    same = depth[order[place]] == base[held]
    out[held[same]] = line[order[place[same]]]
    return out


def ranges_between(marks: str, heads: np.ndarray, lines: np.ndarray | None, needed: np.ndarray | None, most_lines: int | None) -> list[tuple[int, int, int, int]]:
    """(start, stop, first, count) of each function; `first` and `count` tell which of the sorted `lines` lie inside.

    Left out are functions of more than `most_lines` lines and those that hold none of the sorted `needed` lines.
    """
    stops = closing_lines(marks, heads)
    kept = stops >= 0
    if most_lines:
        kept &= stops - heads < most_lines
    if needed is not None:
        kept &= np.searchsorted(needed, heads, "left") < np.searchsorted(needed, stops, "right")
    start, stop = heads[kept], stops[kept]
    inside = np.zeros(0, np.int64) if lines is None else lines
    first = np.searchsorted(inside, start, "left")
    return list(zip(start.tolist(), stop.tolist(), first.tolist(), (np.searchsorted(inside, stop, "right") - first).tolist(), strict=True))


def plain_braces(text: str) -> str:
    """A text without anything but braces and line feeds."""
    return _OTHER.sub("", text)


def may_open(line: str) -> bool:
    """Can the line open a function? Every form of a head has a brace and a bracket or arrow, or the word and a bracket."""
    return ("{" in line and ("(" in line or "=>" in line)) or ("function" in line and "(" in line)


def brace_marks(content: Column) -> Column:
    """A text without anything but braces and line feeds."""
    return F.regexp_replace(content, r"[^{}\n]+", "")


def brace_ranges(marks: Column, heads: Column) -> Column:
    """array<struct(start, stop)>: from each of the ascending head lines to the line where its function closes, if it does."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def ranges(marks: pd.Series, heads: pd.Series) -> pd.Series:
        made = []
        for text, lines in zip(marks, heads, strict=True):
            start = np.asarray(lines if lines is not None else [], np.int64)
            stop = closing_lines(text, start) if len(start) else start
            made.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True) if b >= 0])
        return pd.Series(made)

    return ranges(marks, heads)
