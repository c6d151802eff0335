"""A compiler for a small sandboxed template language: syntax tree, constant folding, Python closures.

Text outside of tags is copied. ``{{ expression }}`` prints; ``{% for x in expression %} .. {% endfor %}``,
``{% if expression %} .. {% elif expression %} .. {% else %} .. {% endif %}`` and
``{% generation %} .. {% endgeneration %}``, whose output is under the loss mask. Expressions have strings, integers,
names, ``a.b`` (an item of a mapping, never an attribute), ``==``, ``!=``, ``not``, ``and``, ``or``, ``+``, brackets and
``value | filter``. In a loop, ``loop.first`` and ``loop.index`` are known. Nothing else can be reached from a template.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

Chunk = tuple[str, bool]  # a piece of output; whether it is under the loss mask


class TemplateError(ValueError):
    """A template that the language does not allow."""


@dataclass(frozen=True)
class Node:
    """kind: const, name, item, not, and, or, eq, ne, add, filter; text, print, for, if, generation, block."""

    kind: str
    value: object = None
    parts: tuple = ()


_TOKEN = re.compile(r"""\s*(?:(?P<str>'[^']*'|"[^"]*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.|+()]))""")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected character in {source!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def parse(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def chain(self, below: Callable[[], Node], kinds: dict[str, str]) -> Node:
        node = below()
        while op := self.take(*kinds):
            node = Node(kinds[op], parts=(node, below()))
        return node

    def either(self) -> Node:
        return self.chain(self.both, {"or": "or"})

    def both(self) -> Node:
        return self.chain(self.negated, {"and": "and"})

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("not") else self.chain(self.sums, {"==": "eq", "!=": "ne"})

    def sums(self) -> Node:
        return self.chain(self.filtered, {"+": "add"})

    def filtered(self) -> Node:
        node = self.atom()
        while self.take("|"):
            node = Node("filter", self.name(), (node,))
        return node

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1]))
        if kind == "int":
            return Node("const", int(text))
        if text == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return node
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        node = Node("name", text)
        while self.take("."):
            node = Node("item", self.name(), (node,))
        return node


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    stack: list[tuple[str, object, list]] = [("block", None, [])]
    at = 0

    def close(kind: str) -> tuple[object, list]:
        if stack[-1][0] != kind or len(stack) == 1:
            raise TemplateError(f"end of {kind} without its start")
        return stack.pop()[1:]

    for m in _TAG.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Node("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Node("print", parts=(_Expression(m[1]).parse(),)))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            target, _, over = rest.strip().partition(" in ")
            if not re.fullmatch(r"[A-Za-z_]\w*", target.strip()):
                raise TemplateError(f"for needs one name, not {target!r}")
            stack.append(("for", (target.strip(), _Expression(over).parse()), []))
        elif word == "endfor":
            (target, over), body = close("for")
            stack[-1][2].append(Node("for", target, (over, Node("block", parts=tuple(body)))))
        elif word == "if":
            stack.append(("if", [(_Expression(rest).parse(), [])], []))
        elif word in ("elif", "else"):
            if stack[-1][0] != "if" or stack[-1][1][-1][0] is None:
                raise TemplateError(f"{word} without if")
            branches = stack[-1][1]
            branches[-1][1].extend(stack[-1][2])
            stack[-1][2].clear()
            branches.append((_Expression(rest).parse() if word == "elif" else None, []))
        elif word == "endif":
            branches, body = close("if")
            branches[-1][1].extend(body)
            stack[-1][2].append(Node("if", parts=tuple((test, Node("block", parts=tuple(b))) for test, b in branches)))
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word == "endgeneration":
            _, body = close("generation")
            stack[-1][2].append(Node("generation", parts=(Node("block", parts=tuple(body)),)))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        stack[-1][2].append(Node("text", source[at:]))
    return Node("block", parts=tuple(stack[0][2]))


_BINARY: dict[str, Callable] = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "add": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def shown(value: object) -> str:
    return "" if value is None else str(value)


def fold(node: Node, filters: Mapping[str, Callable]) -> Node:
    """The tree with what is constant computed: expressions, branches that are decided, neighbouring text."""
    kind = node.kind
    if kind == "filter" and node.value not in filters:
        raise TemplateError(f"unknown filter {node.value!r}")
    if kind in ("filter", "not", *_BINARY):
        parts = tuple(fold(p, filters) for p in node.parts)
        if all(p.kind == "const" for p in parts):
            values = [p.value for p in parts]
            return Node("const", filters[node.value](*values) if kind == "filter" else not values[0] if kind == "not" else _BINARY[kind](*values))
        return Node(kind, node.value, parts)
    if kind == "item":
        return Node(kind, node.value, (fold(node.parts[0], filters),))
    if kind == "print":
        inner = fold(node.parts[0], filters)
        return Node("text", shown(inner.value)) if inner.kind == "const" else Node("print", parts=(inner,))
    if kind == "if":
        branches = []
        for test, body in node.parts:
            test = Node("const", True) if test is None else fold(test, filters)
            if test.kind == "const" and not test.value:
                continue
            branches.append((test, fold(body, filters)))
            if test.kind == "const":
                break
        if branches and branches[0][0].kind == "const":
            return branches[0][1]
        return Node("if", parts=tuple(branches)) if branches else Node("block")
    if kind in ("for", "generation"):
        return Node(kind, node.value, tuple(fold(p, filters) for p in node.parts))
    if kind == "block":
        flat: list[Node] = []
        for p in (fold(p, filters) for p in node.parts):
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "text" and flat and flat[-1].kind == "text":
                    flat[-1] = Node("text", flat[-1].value + q.value)
                elif q.kind != "text" or q.value:
                    flat.append(q)
        return Node("block", parts=tuple(flat))
    return node


def _value(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    """A closure that gives the value of an expression for the names that are known."""
    kind = node.kind
    if kind == "const":
        return lambda names, v=node.value: v
    if kind == "name":
        return lambda names, v=node.value: names.get(v)
    parts = [_value(p, filters) for p in node.parts]
    if kind == "item":

        def item(names, of=parts[0], key=node.value):
            found = of(names)
            return found.get(key) if isinstance(found, dict) else None

        return item
    if kind == "filter":
        return lambda names, f=filters[node.value], of=parts[0]: f(of(names))
    if kind == "not":
        return lambda names, of=parts[0]: not of(names)
    if kind == "and":
        return lambda names, a=parts[0], b=parts[1]: a(names) and b(names)
    if kind == "or":
        return lambda names, a=parts[0], b=parts[1]: a(names) or b(names)
    return lambda names, f=_BINARY[kind], a=parts[0], b=parts[1]: f(a(names), b(names))


def _writer(node: Node, filters: Mapping[str, Callable], masked: bool) -> Callable[[dict], Iterator[Chunk]]:
    """A closure that yields the output of a statement, piece by piece."""
    kind = node.kind
    if kind == "text":

        def text(names, chunk=(node.value, masked)):
            yield chunk

        return text
    if kind == "print":

        def put(names, of=_value(node.parts[0], filters)):
            yield shown(of(names)), masked

        return put
    if kind == "for":

        def loop(names, target=node.value, over=_value(node.parts[0], filters), body=_writer(node.parts[1], filters, masked)):
            for i, x in enumerate(over(names) or ()):
                yield from body({**names, target: x, "loop": {"first": i == 0, "index": i + 1}})

        return loop
    if kind == "if":

        def choose(names, branches=[(_value(t, filters), _writer(b, filters, masked)) for t, b in node.parts]):
            for test, body in branches:
                if test(names):
                    yield from body(names)
                    return

        return choose
    parts = [_writer(p, filters, masked or kind == "generation") for p in node.parts]

    def block(names, parts=parts):
        for p in parts:
            yield from p(names)

    return block


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Iterator[Chunk]]:
    """A function that renders ``source`` for the names that it is given. Iterables are consumed as output is asked for."""
    filters = {"trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower()} | dict(filters or {})
    write = _writer(fold(parse(source), filters), filters, False)
    return lambda **names: write(names)


def render(source: str, filters: Mapping[str, Callable] | None = None, **names: object) -> str:
    return "".join(text for text, _ in compile_template(source, filters)(**names))


def spans(chunks: Iterable[Chunk]) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and the character spans under the loss mask."""
    text, found, at = [], [], 0
    for piece, masked in chunks:
        if masked and piece:
            if found and found[-1][1] == at and found[-1][2]:
                found[-1] = (found[-1][0], at + len(piece), True)
            else:
                found.append((at, at + len(piece), True))
        text.append(piece)
        at += len(piece)
    return "".join(text), [(a, b) for a, b, _ in found]
