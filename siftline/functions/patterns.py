"""Patterns of rules made fit for Python's ``re`` on bytes, the literals that any match must hold, and examples made from patterns."""

from __future__ import annotations

import random
import re
from functools import cache
from re import _constants as op
from re import _parser

#: A flag group in the middle of a pattern, as other engines allow it: (?s) up to the end of the enclosing group.
FLAGS = re.compile(r"\(\?([imsx]+)\)")
#: Shortest literal that is worth a search.
LEAST = 3


def scoped_flags(pattern: str) -> str:
    """``pattern`` with flags at its head hoisted to one group and later ones turned into groups of their own scope."""
    head = ""
    while m := re.match(r"\s*\(\?([imsx]+)\)", pattern):
        head += m[1]
        pattern = pattern[m.end() :]
    out: list[str] = []
    opened = [0]  # for each open group, how many scopes end with it
    in_class, verbose, i = False, "x" in head, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "]" or pattern[i + 1 : i + 3] == "^]":
                take = 2 if pattern[i + 1] == "]" else 3
                out.append(pattern[i : i + take])
                i += take
                continue
        elif pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
            continue
        elif verbose and c == "#":
            i = pattern.find("\n", i) if "\n" in pattern[i:] else len(pattern)
            continue
        elif m := FLAGS.match(pattern, i):
            out.append(f"(?{m[1]}:")
            opened[-1] += 1
            i = m.end()
            continue
        elif c == "(":
            opened.append(0)
        elif c == ")":
            out.append(")" * opened.pop())
        out.append(c)
        i += 1
    body = "".join(out) + ")" * opened[0]
    flags = "".join(sorted(set(head)))
    return f"(?{flags}){body}" if flags else body


def compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(scoped_flags(pattern).replace(r"\z", r"\Z").encode())


def literals(pattern: str) -> frozenset[bytes] | None:
    """Lower-case literals one of which is in every match (with ASCII letters lowered); None if there is no such set."""

    def best(options: list[frozenset[bytes]]) -> frozenset[bytes] | None:
        good = [o for o in options if o and min(map(len, o)) >= LEAST]
        return max(good, key=lambda o: (min(map(len, o)), -len(o)), default=None)

    def of(items: object) -> frozenset[bytes] | None:
        options, run = [], b""
        for kind, value in [*items, (None, None)]:
            if kind is op.LITERAL and value < 128:
                run += bytes([value]).lower()
                continue
            if run:
                options.append(frozenset([run]))
                run = b""
            if kind is op.SUBPATTERN:
                options.append(of(value[3]) or frozenset())
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                options.append(of(value[2]) or frozenset())
            elif kind is op.BRANCH:
                parts = [of(b) for b in value[1]]
                if all(parts):
                    options.append(frozenset().union(*parts))
        return best(options)

    return of(_parser.parse(scoped_flags(pattern).replace(r"\z", r"\Z").encode()))


#: Characters that examples are made of, the likeliest to be meant first.
PRINTED = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + "-_./:=+@!#$%&'\"()*,;<>?[]^`{|}~\\ \n\t"
_CLASSES = {
    op.CATEGORY_DIGIT: (r"\d", str.isdigit), op.CATEGORY_NOT_DIGIT: (r"\D", lambda c: not c.isdigit()),
    op.CATEGORY_SPACE: (r"\s", str.isspace), op.CATEGORY_NOT_SPACE: (r"\S", lambda c: not c.isspace()),
    op.CATEGORY_WORD: (r"\w", lambda c: c.isalnum() or c == "_"), op.CATEGORY_NOT_WORD: (r"\W", lambda c: not (c.isalnum() or c == "_")),
}
_PLACES = {op.AT_BEGINNING: "^", op.AT_BEGINNING_STRING: r"\A", op.AT_END: "$", op.AT_END_STRING: r"\z", op.AT_BOUNDARY: r"\b", op.AT_NON_BOUNDARY: r"\B"}


def _parsed(pattern: str) -> _parser.SubPattern:
    return _parser.parse(scoped_flags(pattern).replace(r"\z", r"\Z").encode())


def _members(items: list, c: str) -> bool:
    """Whether a character is in a class of the parsed pattern."""
    hit, negated = False, False
    for kind, value in items:
        negated |= kind is op.NEGATE
        hit |= (
            (kind is op.LITERAL and ord(c) == value) or (kind is op.RANGE and value[0] <= ord(c) <= value[1])
            or (kind is op.CATEGORY and _CLASSES[value][1](c))
        )
    return hit != negated


@cache
def example(pattern: str) -> str | None:
    """A text that the pattern matches, made from the pattern; None if none of a hundred attempts is one. Always the same."""
    tree, regex = _parsed(pattern), compiled(pattern)
    for attempt in range(100):
        draw = random.Random(attempt)

        def text(items: object, draw: random.Random = draw) -> str:
            out = ""
            for kind, value in items:
                if kind is op.LITERAL:
                    out += chr(value)
                elif kind is op.NOT_LITERAL:
                    out += next(c for c in draw.sample(PRINTED[:62], 2) if ord(c) != value)
                elif kind is op.ANY:
                    out += draw.choice(" =:")  # what stands between words, in most patterns
                elif kind is op.IN:
                    fit = [c for c in PRINTED if _members(value, c)]
                    out += draw.choice([c for c in fit if c.isalnum()] or fit)
                elif kind is op.SUBPATTERN:
                    out += text(value[3])
                elif kind is op.BRANCH:
                    out += text(draw.choice(value[1]))
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                    least, most, inner = value
                    out += "".join(text(inner) for _ in range(min(int(most), least + draw.choice([0, 0, 1, 3]))))
            return out

        around = ("", " ", "\n", "'")[attempt % 4]
        made = around + text(tree) + around
        if regex.search(made.encode()):
            return made
    return None


def plain(pattern: str) -> str:
    """The pattern without comments, free spacing or flags at its head, as other engines read it; groups keep no numbers."""

    def char(value: int) -> str:
        return chr(value) if chr(value).isalnum() else f"\\x{value:02x}"

    def of(items: object) -> str:
        out = ""
        for kind, value in items:
            if kind is op.LITERAL:
                out += char(value)
            elif kind is op.NOT_LITERAL:
                out += f"[^{char(value)}]"
            elif kind is op.ANY:
                out += "."
            elif kind is op.AT:
                out += _PLACES[value]
            elif kind is op.IN:
                parts = {op.NEGATE: lambda _: "^", op.LITERAL: char, op.RANGE: lambda v: f"{char(v[0])}-{char(v[1])}", op.CATEGORY: lambda v: _CLASSES[v][0]}
                out += "[" + "".join(parts[k](v) for k, v in value) + "]"
            elif kind is op.SUBPATTERN:
                out += scoped(value[1], of(value[3]))
            elif kind is op.BRANCH:
                out += "(?:" + "|".join(map(of, value[1])) + ")"
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
                least, most, inner = value
                lazy = "?" if kind is op.MIN_REPEAT else ""
                once, least, most = f"(?:{of(inner)})", int(least), None if most is op.MAXREPEAT else int(most)
                if most is None:
                    out += f"{once}{{{least},}}{lazy}"
                else:  # in parts: engines have a largest count
                    for at in range(0, max(most, 1), 1000):
                        out += f"{once}{{{min(max(least - at, 0), 1000)},{min(most - at, 1000)}}}{lazy}"
            else:
                raise ValueError(f"{kind} has no plain form")
        return out

    def scoped(flags: int, body: str) -> str:
        named = "".join(n for n, f in (("i", re.I), ("m", re.M), ("s", re.S)) if flags & f)
        return f"(?{named}:{body})"

    tree = _parsed(pattern)
    return scoped(tree.state.flags, of(tree))
