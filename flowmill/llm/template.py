"""A sandboxed template language, compiled: source -> tokens -> syntax tree -> folded tree -> Python closures.

Text outside of marks is literal. Marks:

    {{ expression }}                          print a value
    {% if e %} {% elif e %} {% else %} {% end %}
    {% for name in e %} ... {% end %}         the loop has loop.first, loop.index (from 0)
    {% generation %} ... {% end %}            what is printed inside is what a model is trained on

Expressions: 'strings' and "strings" (with \\n, \\t, \\\\ and quote escapes), whole numbers, true, false, none, names,
a.b and a['b'] (mappings only), + (joins strings), ==, !=, and, or, not, parentheses, and e | filter. There are no
calls, attributes of Python objects, imports or assignments, so a template can read nothing but its variables.
Filters are the functions in FILTERS. Marks inside a value are not read again.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

FILTERS: dict[str, Callable[[Any], Any]] = {
    "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "trim": lambda x: str(x).strip(), "length": lambda x: len(x),
}

_MARK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEX = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[+|().\[\]]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template can't be parsed, or reads what it may not."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """Recursive descent over one mark's tokens."""

    def __init__(self, source: str, filters: Mapping[str, Any]):
        self.tokens, self.at, self.filters = [], 0, filters
        pos, source = 0, source.strip()
        while pos < len(source):
            found = _LEX.match(source, pos)
            if not found:
                raise TemplateError(f"can't read {source[pos:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            pos = found.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None, *values: str) -> str:
        if self.at == len(self.tokens) or kind and self.tokens[self.at][0] != kind or values and self.tokens[self.at][1] not in values:
            raise TemplateError(f"expected {' or '.join(values) or kind}, got {self.tokens[self.at:self.at + 1]}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at:]}")
        return out

    def _chain(self, signs: tuple[str, ...], below):
        out = below()
        while self.peek(*signs):
            sign = self.take()
            out = Op(sign, (out, below()))
        return out

    def either(self):
        return self._chain(("or",), self.both)

    def both(self):
        return self._chain(("and",), self.negated)

    def negated(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        return self._chain(("==", "!="), self.sums)

    def sums(self):
        return self._chain(("+",), self.filtered)

    def filtered(self):
        out = self.path()
        while self.peek("|"):
            self.take()
            if (name := self.take("name")) not in self.filters:
                raise TemplateError(f"no filter {name}")
            out = Filter(name, out)
        return out

    def path(self):
        out = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                out = Item(out, Const(self.take("name")))
            else:
                out = Item(out, self.either())
                self.take("sign", "]")
        return out

    def atom(self):
        if self.peek("("):
            self.take()
            out = self.either()
            self.take("sign", ")")
            return out
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(ast.literal_eval(value if "\n" not in value else value[0] * 2 + value + value[0] * 2))
        if kind == "number":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not"):
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: Mapping[str, Any] = FILTERS) -> tuple:
    """The syntax tree: a tuple of nodes."""
    parts: list[tuple[str, str]] = []
    at = 0
    for found in _MARK.finditer(source):
        parts += [("text", source[at : found.start()]), ("print", found[1]) if found[1] is not None else ("tag", found[2].strip())]
        at = found.end()
    parts.append(("text", source[at:]))
    where = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal where
        out = []
        while where < len(parts):
            kind, text = parts[where]
            where += 1
            if kind == "text":
                if text:
                    out.append(Print(Const(text)))
                continue
            if kind == "print":
                out.append(Print(_Expression(text, filters).whole()))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), text
            if word == "if":
                out.append(branch(rest))
            elif word == "for":
                named = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not named:
                    raise TemplateError(f"can't read for {rest}")
                out.append(For(named[1], _Expression(named[2], filters).whole(), block(("end",))[0]))
            elif word == "generation":
                out.append(Generation(block(("end",))[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag {text!r}")
        if ends:
            raise TemplateError("a block isn't ended")
        return tuple(out), ""

    def branch(test: str) -> If:
        then, end = block(("elif", "else", "end"))
        if end.startswith("elif"):
            return If(_Expression(test, filters).whole(), then, (branch(end[4:]),))
        return If(_Expression(test, filters).whole(), then, block(("end",))[0] if end.startswith("else") else ())

    return block(())[0]


def _joined(a: Any, b: Any) -> str:
    return ("" if a is None else str(a)) + ("" if b is None else str(b))


def fold(node: Any) -> Any:
    """The same tree with constant expressions computed, known branches taken and neighbouring literals joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Print) and isinstance(y.value, Const):
                    text = "" if y.value.value is None else str(y.value.value)
                    if out and isinstance(out[-1], Print) and isinstance(out[-1].value, Const):
                        out[-1] = Print(Const(out[-1].value.value + text))
                    elif text:
                        out.append(Print(Const(text)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        values = [x.value for x in args if isinstance(x, Const)]
        if len(values) == len(args):
            return Const(_OPS[node.sign](*values))
        if node.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.sign == "and") else args[0]
        return Op(node.sign, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) and node.name in FILTERS else Filter(node.name, of)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Print):
        return Print(fold(node.value))
    if isinstance(node, If):
        test, then, other = fold(node.test), fold(node.then), fold(node.other)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


_OPS: dict[str, Callable] = {
    "+": _joined, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}

Scope = dict[str, Any]


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, x=node.value: x
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Filter):
        of, call = _value(node.of, filters), filters[node.name]
        return lambda scope: call(of(scope))
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope: Scope) -> Any:
            found = of(scope)
            if not isinstance(found, Mapping):
                raise TemplateError(f"{type(found).__name__} has no items")
            return found.get(key(scope))

        return item
    args = [_value(x, filters) for x in node.args]
    if node.sign == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.sign == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if node.sign == "not":
        return lambda scope: not args[0](scope)
    call, (a, b) = _OPS[node.sign], args
    return lambda scope: call(a(scope), b(scope))


Out = Iterator[tuple[str, bool]]


def _body(nodes: tuple, filters: Mapping[str, Callable]) -> Callable[[Scope, bool], Out]:
    steps = [_step(x, filters) for x in nodes]

    def run(scope: Scope, trained: bool) -> Out:
        for step in steps:
            yield from step(scope, trained)

    return run


def _step(node: Any, filters: Mapping[str, Callable]) -> Callable[[Scope, bool], Out]:
    if isinstance(node, Print):
        value = _value(node.value, filters)

        def show(scope: Scope, trained: bool) -> Out:
            found = value(scope)
            if found is not None:
                yield str(found), trained

        return show
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _body(node.then, filters), _body(node.other, filters)
        return lambda scope, trained: (then if test(scope) else other)(scope, trained)
    if isinstance(node, Generation):
        inner = _body(node.body, filters)
        return lambda scope, trained: inner(scope, True)
    over, body = _value(node.over, filters), _body(node.body, filters)

    def loop(scope: Scope, trained: bool) -> Out:
        for i, x in enumerate(over(scope) or ()):
            yield from body(scope | {node.name: x, "loop": {"first": i == 0, "index": i}}, trained)

    return loop


@dataclass
class Template:
    """A compiled template. `stream` renders lazily, so that a very long conversation is never held whole."""

    source: str
    filters: Mapping[str, Callable[[Any], Any]] = field(default_factory=dict)

    def __post_init__(self):
        known = {**FILTERS, **self.filters}
        self._run = _body(fold(parse(self.source, known)), known)

    def stream(self, **scope: Any) -> Iterable[tuple[str, bool]]:
        """(text, whether it is under the generation mask), piece by piece."""
        return self._run(scope, False)

    def render(self, **scope: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the (start, end) of the spans under the generation mask; neighbours are joined."""
        parts, spans, at = [], [], 0
        for text, trained in self.stream(**scope):
            if trained and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            parts.append(text)
            at += len(text)
        return "".join(parts), spans
