"""Globs, LIKE patterns and the literals of regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_like(glob: str) -> str:
    """** and * become %, ? becomes _; slashes around ** go with it. **/*.py is %%.py, src/** is src%, **/dir/** is %dir%."""
    out = glob.replace("\\", "\\\\").replace("_", "\\_")
    out = re.sub(r"/?\*\*/?", "%", out)
    return out.replace("*", "%").replace("?", "_")


def matches_glob(path: Column, glob: str) -> Column:
    """A glob, or, without wildcards, any path that contains it."""
    return path.like(glob_to_like(glob)) if re.search(r"[*?]", glob) else path.contains(glob)


def regex_hints(pattern: str, least: int = 3) -> list[str]:
    """Literals that every match contains, of least characters or more; none where an alternation or a group leaves it open."""
    if "|" in pattern or "(" in pattern.removeprefix("(?i)"):
        return []
    found, run, k = [], "", 0
    text = pattern.removeprefix("(?i)")

    def flush() -> None:
        nonlocal run
        if len(run) >= least:
            found.append(run)
        run = ""

    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            if text[k + 1].isalnum():
                flush()
            else:
                run += text[k + 1]
            k += 2
            continue
        if c == "[":
            flush()
            end = text.find("]", k + 2)
            k = len(text) if end < 0 else end + 1
            continue
        if c in "*?{":  # what is before may be absent
            run = run[:-1]
            flush()
            k = text.find("}", k) + 1 if c == "{" and "}" in text[k:] else k + 1
            continue
        if c in ".^$+":
            flush()
        else:
            run += c
        k += 1
    flush()
    return found
