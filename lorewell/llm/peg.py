"""A small parsing-expression grammar: ordered choice, repetition, look-ahead and named nodes over a string.

A parser takes (text, position) and gives (end, nodes) or None. Terminals are compiled patterns matched at the position,
so that runs of ordinary text cost one step.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

Result = tuple[int, list] | None
Parser = Callable[[str, int], Result]


class Node(NamedTuple):
    kind: str
    start: int
    end: int
    value: Any
    children: list


def term(pattern: str) -> Parser:
    match = re.compile(pattern).match

    def run(s: str, i: int) -> Result:
        m = match(s, i)
        return (m.end(), []) if m else None

    return run


def seq(*parts: Parser) -> Parser:
    def run(s: str, i: int) -> Result:
        nodes: list = []
        for p in parts:
            r = p(s, i)
            if r is None:
                return None
            i = r[0]
            nodes += r[1]
        return i, nodes

    return run


def choice(*parts: Parser) -> Parser:
    def run(s: str, i: int) -> Result:
        for p in parts:
            r = p(s, i)
            if r is not None:
                return r
        return None

    return run


def many(part: Parser) -> Parser:
    def run(s: str, i: int) -> Result:
        nodes: list = []
        while True:
            r = part(s, i)
            if r is None or r[0] == i:
                return i, nodes
            i = r[0]
            nodes += r[1]

    return run


def maybe(part: Parser) -> Parser:
    def run(s: str, i: int) -> Result:
        return part(s, i) or (i, [])

    return run


def unless(part: Parser) -> Parser:
    return lambda s, i: (i, []) if part(s, i) is None else None


def named(kind: str, part: Parser, value: Callable[[str], Any] | None = None) -> Parser:
    """A node for what `part` takes; with `value`, fails where that gives None."""

    def run(s: str, i: int) -> Result:
        r = part(s, i)
        if r is None:
            return None
        v = value(s[i:r[0]]) if value else None
        if value and v is None:
            return None
        return r[0], [Node(kind, i, r[0], v, r[1])]

    return run


def nested(pairs: dict[str, str], leaf: Parser, plain: Parser) -> Parser:
    """Brackets within brackets to any depth, with leaves and plain text between: open (nested / leaf / plain)* close.

    The rule that refers to itself is run on a stack of its own. Where it fails, every bracket that was open then fails
    too; these positions are kept for the text, so that none is read again.
    """
    held: list = ["", set()]

    def run(s: str, i: int) -> Result:
        if i >= len(s) or s[i] not in pairs:
            return leaf(s, i)
        if held[0] is not s:
            held[:] = [s, set()]
        failed: set[int] = held[1]
        open_: list[int] = []
        at = i
        while at < len(s):
            c = s[at]
            if c in pairs and at not in failed:
                open_.append(at)
                at += 1
            elif open_ and c == pairs[s[open_[-1]]]:
                open_.pop()
                at += 1
                if not open_:
                    return at, []
            elif open_ and (r := leaf(s, at) or plain(s, at)) is not None and r[0] > at:
                at = r[0]
            else:
                break
        failed.update(open_)
        return None

    return run
