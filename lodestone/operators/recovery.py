"""Definitions of Python files that don't parse: a scan over logical lines and their indentation.

A logical line ends where no bracket or string is open.  What is broken ends early: a line that
begins a definition can't stand within brackets, so an open bracket before it is given up, and quotes
that are never closed are passed over.  A definition counts if its header is whole; it ends with the
last logical line that is indented deeper.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_PIECE = re.compile(r"""(?P<triple>\"{3}|'{3})|(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)|(?P<comment>#.*)|(?P<open>[(\[{])|(?P<close>[)\]}])""")
_BEGINS = re.compile(r"\s*(?:async\s+def|def|class)\s+\w")
_STATEMENT = re.compile(r"\s*(?:@\w|import\s|from\s+\S+\s+import\s)")
_HEADER = re.compile(r"(?:(?:async\s+)?def\s+(?P<f>\w+)\s*(?:\[\])?\s*\(\)\s*(?:->[^:]*)?|class\s+(?P<c>\w+)\s*(?:\[\])?\s*(?:\(\))?\s*):")
_CONFLICT = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?:\s|$)")


@dataclass
class Line:
    """A logical line: its first and last line (from 1), indentation, and what of it stands outside brackets, strings and comments."""

    first: int
    last: int
    indent: int
    code: str


def _closed(lines: list[str], at: int, column: int, quotes: str) -> tuple[int, int] | None:
    """Where a triple-quoted string that was opened before the place ends."""
    while at < len(lines):
        found = re.compile(r"(?:\\.|(?!" + quotes + r").)*" + quotes, re.S).match(lines[at], column)
        if found:
            return at, found.end()
        at, column = at + 1, 0
    return None


def logical_lines(source: str) -> list[Line]:
    lines, out, at = source.splitlines(), [], 0
    while at < len(lines):
        text = lines[at]
        if not text.strip() or text.lstrip().startswith("#") or _CONFLICT.match(text):
            at += 1
            continue
        indent = len(text.expandtabs()) - len(text.expandtabs().lstrip())
        first, depth, column, code = at, 0, 0, []
        while True:
            found = _PIECE.search(lines[at], column)
            if not depth:
                code.append(lines[at][column : found.start() if found else None])
            if found and found["triple"]:
                end = _closed(lines, at, found.end(), found["triple"])
                at, column = end or (at, found.end())
                continue
            if found:
                if found["open"]:
                    code.append(found["open"] if not depth else "")
                    depth += 1
                elif found["close"]:
                    depth = max(0, depth - 1)
                    code.append(found["close"] if not depth else "")
                elif found["string"] and not depth:
                    code.append("''")
                column = found.end()
                continue
            goes_on = lines[at].endswith("\\") or depth
            if not goes_on or at + 1 >= len(lines) or _BEGINS.match(lines[at + 1]):
                break
            following = lines[at + 1]
            if _STATEMENT.match(following) and len(following.expandtabs()) - len(following.expandtabs().lstrip()) <= indent:
                break
            at, column = at + 1, 0
        out.append(Line(first + 1, at + 1, indent, "".join(code).strip()))
        at += 1
    return out


def definitions(source: str) -> list[tuple[str, int, int]]:
    """Qualified name, first line (of its decorators, if it has any) and last line of each definition."""
    found: list[list] = []
    around: list[tuple[int, str, int]] = []  # indentation, name and place among the found of what a line stands in
    decorated: tuple[int, int] | None = None
    for line in logical_lines(source):
        while around and around[-1][0] >= line.indent:
            around.pop()
        for _, _, i in around:
            found[i][2] = line.last
        header = _HEADER.match(line.code)
        if header:
            name = header["f"] or header["c"]
            start = decorated[1] if decorated and decorated[0] == line.indent else line.first
            found.append([".".join([*(n for _, n, _ in around), name]), start, line.last])
            around.append((line.indent, name, len(found) - 1))
        if not re.match(r"@\s*[\w(]", line.code):
            decorated = None
        elif not decorated or decorated[0] != line.indent:
            decorated = (line.indent, line.first)
    return [tuple(x) for x in found]
