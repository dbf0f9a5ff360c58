"""A small sandboxed template language, compiled to Python closures.

Source -> tokens -> syntax tree -> folded tree -> closures.  The language has text,
``{{ expression }}``, ``{% for name in name %}``, ``{% if %} {% elif %} {% else %} {% endif %}``
and ``{% generation %} ... {% endgeneration %}``, which marks what a model is trained on.
Expressions: strings, integers, true, false, names, ``name.field``, ``==``, ``!=``, ``not``,
``and``, ``or``, ``~`` (joins strings), parentheses and ``value|filter``.  There are no calls,
no item access, no Python attributes and no filters but the registered ones: ``name.field``
reads a mapping, so nothing outside the data given to ``render`` can be reached.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The template is not in the language, or names what was not given."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[|().~]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False}
_RESERVED = {"and", "or", "not", "in"}


class _Expression:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def whole(self):
        value = self.either()
        if self.peek()[0]:
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        op = self.take("==", "!=")
        return Op(op, (left, self.joined())) if op else left

    def joined(self):
        left = self.filtered()
        while self.take("~"):
            left = Op("~", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.atom()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError("a filter's name is missing")
            self.at += 1
            value = Filter(name, value)
        return value

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value in _WORDS:
            return Const(_WORDS[value])
        if kind == "name" and value not in _RESERVED:
            if not self.take("."):
                return Name(value)
            kind, field = self.peek()
            if kind != "name":
                raise TemplateError("a field's name is missing")
            self.at += 1
            return Name(value, field)
        if kind == "op" and value == "(":
            inner = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is not closed")
            return inner
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """Syntax tree of a template: a tuple of nodes."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("emit", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    pos = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        nodes = []
        while pos < len(parts):
            kind, body = parts[pos]
            pos += 1
            if kind == "text":
                if body:
                    nodes.append(Emit(Const(body)))
            elif kind == "emit":
                nodes.append(Emit(_Expression(body).whole()))
            else:
                word = body.split(None, 1)[0] if body else ""
                if word in ends:
                    return tuple(nodes), body
                nodes.append(statement(word, body[len(word) :].strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    def branches(test: str) -> If:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), then, (branches(end[4:]),))
        return If(_Expression(test).whole(), then, block("endif")[0] if end == "else" else ())

    def statement(word: str, rest: str):
        if word == "if":
            return branches(rest)
        if word == "for":
            m = re.fullmatch(r"([A-Za-z][A-Za-z0-9_]*)\s+in\s+([A-Za-z][A-Za-z0-9_]*)", rest)
            if not m:
                raise TemplateError(f"for {rest!r} is not 'name in name'")
            return For(m[1], m[2], block("endfor")[0])
        if word == "generation" and not rest:
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


_BINARY: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: f"{a}{b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(tree: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """The same tree with constant expressions evaluated, dead branches gone and adjacent texts joined."""

    def value(x):
        if isinstance(x, Filter):
            if x.name not in filters:
                raise TemplateError(f"unknown filter {x.name!r}")
            arg = value(x.arg)
            return Const(filters[x.name](str(arg.value))) if isinstance(arg, Const) else Filter(x.name, arg)
        if not isinstance(x, Op):
            return x
        args = tuple(map(value, x.args))
        if all(isinstance(a, Const) for a in args):
            return Const(not args[0].value if x.kind == "not" else _BINARY[x.kind](args[0].value, args[1].value))
        if x.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.kind == "and") else args[0]
        return Op(x.kind, args)

    out: list = []
    for node in tree:
        if isinstance(node, Emit):
            new = [Emit(value(node.value))]
        elif isinstance(node, If):
            test = value(node.test)
            then, other = fold(node.then, filters), fold(node.other, filters)
            new = list(then if test.value else other) if isinstance(test, Const) else [If(test, then, other)]
        elif isinstance(node, For):
            new = [For(node.name, node.over, fold(node.body, filters))]
        else:
            new = [Generation(fold(node.body, filters))]
        for x in new:
            if isinstance(x, Emit) and isinstance(x.value, Const):
                text = str(x.value.value)
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(str(out[-1].value.value) + text))
                elif text:
                    out.append(Emit(Const(text)))
            else:
                out.append(x)
    return tuple(out)


Pieces = Iterator[tuple[str, bool]]


def _value_closure(x, filters) -> Callable[[dict], Any]:
    if isinstance(x, Const):
        return lambda env, v=x.value: v
    if isinstance(x, Name):

        def look(env: dict, name=x.name, field=x.field):
            try:
                return env[name] if field is None else env[name][field]
            except (KeyError, TypeError):
                raise TemplateError(f"{name}{'.' + field if field else ''} is not given") from None

        return look
    if isinstance(x, Filter):
        arg, f = _value_closure(x.arg, filters), filters[x.name]
        return lambda env: f(str(arg(env)))
    args = [_value_closure(a, filters) for a in x.args]
    if x.kind == "not":
        return lambda env: not args[0](env)
    if x.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if x.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _BINARY[x.kind]
    return lambda env: f(args[0](env), args[1](env))


def _block_closure(tree: tuple, filters) -> Callable[[dict, bool], Pieces]:
    steps = []
    for node in tree:
        if isinstance(node, Emit):
            v = _value_closure(node.value, filters)
            steps.append(lambda env, loss, v=v: iter(((str(v(env)), loss),)))
        elif isinstance(node, If):
            test, then, other = _value_closure(node.test, filters), _block_closure(node.then, filters), _block_closure(node.other, filters)
            steps.append(lambda env, loss, test=test, then=then, other=other: (then if test(env) else other)(env, loss))
        elif isinstance(node, For):
            body, over = _block_closure(node.body, filters), _value_closure(Name(node.over), filters)

            def loop(env, loss, body=body, over=over, name=node.name):
                for item in over(env):
                    yield from body(env | {name: item}, loss)

            steps.append(loop)
        else:
            steps.append(lambda env, loss, body=_block_closure(node.body, filters): body(env, True))

    def run(env: dict, loss: bool) -> Pieces:
        for step in steps:
            yield from step(env, loss)

    return run


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[..., Pieces]:
    """``render(**values)`` yields (text, is under the generation marker) in order.

    Loops pull their items one by one, so a list may be an endless iterator.
    """
    run = _block_closure(fold(parse(source), filters), filters)
    return lambda **values: run(dict(values), False)
