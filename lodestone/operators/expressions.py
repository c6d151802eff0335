"""Conditions of templates: read once on the driver into a tree of tuples, then evaluated there or made into a column.

``or`` binds least, then ``and``, then ``not``; brackets group. ==, !=, in, not in, exists, else the truth of a name.
"""

from __future__ import annotations

import re

#: Quoted text, a list, brackets, comparisons, or a run of anything else.
_TOKEN = re.compile(r"""\s*(?:("[^"]*"|'[^']*')|(\[[^\]]*\])|([()])|(==|!=)|([^\s()\[\]=!"']+(?:\[\d+\][^\s()\[\]=!"']*)*))""")
Node = tuple


def tokens(expression: str) -> list[str]:
    out, at = [], 0
    text = expression.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r} in condition {expression!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


def _items(text: str) -> list[str]:
    """What commas separate within a list, quoted text as it is."""
    return [m[0].strip() for m in re.finditer(r"""\s*(?:"[^"]*"|'[^']*'|[^,"']+)""", text[1:-1]) if m[0].strip()]


def operand(token: str) -> Node:
    if token[:1] == "[":
        return ("list", [operand(t) for t in _items(token)])
    if token[:1] in "'\"":
        return ("text", token[1:-1])
    return ("name", token)


def parse(expression: str) -> Node:
    """A tree of ("or" | "and", parts), ("not", x), ("==" | "!=" | "in" | "not in", a, b), ("exists", a) and ("truth", a)."""
    left = tokens(expression)

    def take(word: str) -> bool:
        if left and left[0] == word:
            left.pop(0)
            return True
        return False

    def several(word: str, part) -> Node:
        parts = [part()]
        while take(word):
            parts.append(part())
        return parts[0] if len(parts) == 1 else (word, parts)

    def either() -> Node:
        return several("or", both)

    def both() -> Node:
        return several("and", one)

    def one() -> Node:
        if take("not"):
            return ("not", one())
        if take("("):
            inner = either()
            if not take(")"):
                raise ValueError(f"a bracket isn't closed in condition {expression!r}")
            return inner
        if not left or left[0] in (")", "and", "or", "==", "!="):
            raise ValueError(f"something is missing in condition {expression!r}")
        a = operand(left.pop(0))
        if take("exists"):
            return ("exists", a)
        for word in ("==", "!=", "in"):
            if take(word):
                return (word, a, second())
        if left[:2] == ["not", "in"]:
            del left[:2]
            return ("not in", a, second())
        return ("truth", a)

    def second() -> Node:
        if not left:
            raise ValueError(f"something is missing in condition {expression!r}")
        return operand(left.pop(0))

    tree = either()
    if left:
        raise ValueError(f"{' '.join(left)!r} is left over in condition {expression!r}")
    return tree
