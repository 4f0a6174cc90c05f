"""Ignore rules in the syntax of gitignore, as one regular expression for each line; the last line that matches decides."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = Path(__file__).resolve().parent.parent / "data" / "ignore.txt"


def to_regex(line: str) -> tuple[bool, str] | None:
    """(negated, expression for a path relative to the root, with / between its parts); None for comments and blanks."""
    line = line.rstrip("\n")
    if not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    if line.startswith("\\"):
        line = line[1:]
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif line[i] == "*":
            while line.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inner = line[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            if line[i] == "\\" and i + 1 < len(line):
                i += 1
            out, i = out + re.escape(line[i]), i + 1
    return negated, f"^{out}/.*$" if only_dirs else f"^{out}(?:/.*)?$"


def lines(*paths: Path | str, default: bool = True) -> list[str]:
    return [line for p in ([DEFAULT] if default else []) + list(paths) for line in Path(p).read_text().splitlines()]


def ignored(path: Column, rules: Iterable[str]) -> Column:
    """Whether a path below the root is ignored. A root itself (the empty path) never is."""
    verdict = F.lit(False)
    run: list[str] = []
    state = False
    for negated, regex in [x for x in map(to_regex, rules) if x] + [(None, "")]:
        if negated is not state and run:
            verdict = F.when(path.rlike("|".join(f"(?:{r})" for r in run)), F.lit(not state)).otherwise(verdict)
            run = []
        state = negated
        run.append(regex)
    return F.when(path == "", False).otherwise(verdict)
