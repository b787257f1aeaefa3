"""A small, sandboxed template language for conversations.

A template is parsed into a syntax tree, constants in the tree are folded, and
the tree becomes nested Python closures.  Nothing is evaluated from text, names
reach only what the caller passes in, and attributes are keys of mappings, so
a template can't touch Python objects.  A variable can gather texts, but not
double them turn by turn.

    {{ expression }}                                prints
    {% for x in xs %} .. {% endfor %}               loops; loop.index, loop.index0, loop.first, loop.last
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = e %}
    {% generation %} .. {% endgeneration %}         what a model is trained to write

Expressions: strings, whole numbers, true, false, none, names, ``a.b``,
``== != < > <= >= in``, ``+ - * % ~``, ``and or not``, parentheses, and the
filters trim, upper, lower, length, string, escape.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """What is wrong with a template, and where."""


#: Characters that a variable may hold in any case, and times the given texts by which it may outgrow the longest text at hand.
FREE = 1 << 16
GROWTH = 4


# --- syntax tree -----------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Attr:
    of: Any
    name: str


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Print:
    what: Any


@dataclass(frozen=True)
class Set:
    name: str
    what: Any


@dataclass(frozen=True)
class If:
    tests: tuple[tuple[Any, tuple], ...]


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parsing ---------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>==|!=|<=|>=|[<>+\-*%~().|=]))""", re.S)
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in", "for", "if", "elif", "else", "set"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("*", "%"))


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:].strip()[:20]!r}")
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "str":
            text = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.S)
        out.append((kind, int(text) if kind == "int" else text))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing over the tokens of one expression."""

    def __init__(self, tokens: list[tuple[str, Any]]) -> None:
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> Any:
        kind, value = self.peek()
        if kind in ("op", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def whole(self) -> Any:
        tree = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def level(self, k: int) -> Any:
        if k == len(_LEVELS):
            return self.unary()
        if k == 2 and self.take("not"):
            return Unary("not", self.level(k))
        tree = self.level(k + 1)
        while op := self.take(*_LEVELS[k]):
            tree = Binary(op, tree, self.level(k + 1))
        return tree

    def unary(self) -> Any:
        if self.take("-"):
            return Unary("-", self.unary())
        kind, value = self.peek()
        self.at += 1
        if kind in ("str", "int"):
            tree: Any = Const(value)
        elif kind == "name" and value in _CONSTANTS:
            tree = Const(_CONSTANTS[value])
        elif kind == "name" and value not in _WORDS:
            tree = Name(value)
        elif value == "(" and kind == "op":
            tree = self.level(0)
            if not self.take(")"):
                raise TemplateError("a parenthesis is not closed")
        else:
            raise TemplateError(f"an expression is missing before {value!r}")
        while op := self.take(".", "|"):
            kind, value = self.peek()
            self.at += 1
            if kind != "name":
                raise TemplateError(f"a name is missing after {op!r}")
            tree = Attr(tree, value) if op == "." else Filter(value, tree)
        return tree


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]
    at = 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Print(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Print(_Expression(_tokens(m[1])).whole()))
            continue
        tokens = _tokens(m[2])
        word, rest = (tokens[0][1], tokens[1:]) if tokens else ("", [])
        if word == "for":
            if len(rest) < 3 or rest[0][0] != "name" or rest[1] != ("name", "in"):
                raise TemplateError("for needs a name, in and an expression")
            stack.append(("for", (rest[0][1], _Expression(rest[2:]).whole()), []))
        elif word == "if":
            stack.append(("if", [[_Expression(rest).whole(), None]], []))
        elif word in ("elif", "else"):
            kind, tests, body = stack.pop()
            if kind != "if" or tests[-1][0] is None:
                raise TemplateError(f"{word} is not inside an if")
            tests[-1][1] = tuple(body)
            stack.append(("if", [*tests, [_Expression(rest).whole() if word == "elif" else None, None]], []))
        elif word == "set":
            if len(rest) < 3 or rest[0][0] != "name" or rest[1] != ("op", "="):
                raise TemplateError("set needs a name, = and an expression")
            stack[-1][2].append(Set(rest[0][1], _Expression(rest[2:]).whole()))
        elif word == "generation":
            if any(kind == "generation" for kind, _, _ in stack):
                raise TemplateError("generation can't hold generation")
            stack.append(("generation", None, []))
        elif word in ("endfor", "endif", "endgeneration"):
            kind, head, body = stack.pop()
            if not kind or word != f"end{kind}":
                raise TemplateError(f"{word} closes nothing")
            if kind == "for":
                node: Any = For(*head, tuple(body))
            elif kind == "if":
                head[-1][1] = tuple(body)
                node = If(tuple((t if t is not None else Const(True), b) for t, b in head))
            else:
                node = Generation(tuple(body))
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"unknown statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        stack[-1][2].append(Print(Const(source[at:])))
    return tuple(stack[0][2])


# --- operations ------------------------------------------------------------------


def shown(value: Any) -> str:
    """A value as it is printed: none as nothing."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else str(value)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "%": lambda a, b: a % b,
    "~": lambda a, b: shown(a) + shown(b),
}
_UNARY: dict[str, Callable[[Any], Any]] = {"not": lambda a: not a, "-": lambda a: -a}


def _numbers_only(op: str, a: Any, b: Any) -> Any:
    """``*`` and ``%`` take numbers only: else ``'x' * 10 ** 9`` would eat the memory."""
    if op in ("*", "%", "-") and not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError(f"{op} takes numbers")
    return _BINARY[op](a, b)


# --- constant folding ------------------------------------------------------------


def _fold_expression(tree: Any, filters: Mapping[str, Callable[[Any], Any]]) -> Any:
    if isinstance(tree, Attr):
        return Attr(_fold_expression(tree.of, filters), tree.name)
    if isinstance(tree, Filter):
        of = _fold_expression(tree.of, filters)
        return Const(filters[tree.name](of.value)) if isinstance(of, Const) and tree.name in filters else Filter(tree.name, of)
    if isinstance(tree, Unary):
        of = _fold_expression(tree.of, filters)
        return Const(_UNARY[tree.op](of.value)) if isinstance(of, Const) else Unary(tree.op, of)
    if isinstance(tree, Binary):
        left, right = _fold_expression(tree.left, filters), _fold_expression(tree.right, filters)
        if tree.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (tree.op == "and") else left
        if tree.op not in ("and", "or") and isinstance(left, Const) and isinstance(right, Const):
            return Const(_numbers_only(tree.op, left.value, right.value))
        return Binary(tree.op, left, right)
    return tree


def fold(body: Iterable[Any], filters: Mapping[str, Callable[[Any], Any]]) -> tuple:
    """The tree with constant expressions evaluated, dead branches gone and neighbouring literals joined."""
    out: list[Any] = []
    todo = list(body)[::-1]
    while todo:
        node = todo.pop()
        if isinstance(node, Print):
            what = _fold_expression(node.what, filters)
            if not isinstance(what, Const):
                out.append(Print(what))
            elif text := shown(what.value):
                if out and isinstance(out[-1], Print) and isinstance(out[-1].what, Const):
                    text = out.pop().what.value + text
                out.append(Print(Const(text)))
        elif isinstance(node, Set):
            out.append(Set(node.name, _fold_expression(node.what, filters)))
        elif isinstance(node, For):
            out.append(For(node.name, _fold_expression(node.over, filters), fold(node.body, filters)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body, filters)))
        else:
            live: list[tuple[Any, tuple]] = []
            for test, inner in node.tests:
                test = _fold_expression(test, filters)
                if isinstance(test, Const) and not test.value:
                    continue
                live.append((test, inner))
                if isinstance(test, Const):
                    break
            if live and isinstance(live[0][0], Const):
                todo.extend(live[0][1][::-1])
            elif live:
                out.append(If(tuple((test, fold(inner, filters)) for test, inner in live)))
    return tuple(out)


# --- closures --------------------------------------------------------------------

Env = dict[str, Any]
Pieces = Iterator[tuple[str, bool]]


def _value(tree: Any, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[Env], Any]:
    """The closure of an expression."""
    if isinstance(tree, Const):
        return lambda env, v=tree.value: v
    if isinstance(tree, Name):
        return lambda env, n=tree.name: env.get(n)
    if isinstance(tree, Attr):
        of = _value(tree.of, filters)

        def attribute(env: Env, n: str = tree.name) -> Any:
            value = of(env)
            return value.get(n) if isinstance(value, Mapping) else None

        return attribute
    if isinstance(tree, Filter):
        if tree.name not in filters:
            raise TemplateError(f"unknown filter {tree.name!r}")
        of = _value(tree.of, filters)
        return lambda env, f=filters[tree.name]: f(of(env))
    if isinstance(tree, Unary):
        of = _value(tree.of, filters)
        return lambda env, f=_UNARY[tree.op]: f(of(env))
    left, right = _value(tree.left, filters), _value(tree.right, filters)
    if tree.op == "and":
        return lambda env: left(env) and right(env)
    if tree.op == "or":
        return lambda env: left(env) or right(env)
    return lambda env, op=tree.op: _numbers_only(op, left(env), right(env))


def _grown(name: str, value: Any, env: Env) -> Any:
    """A value to be kept under a name, refused if it outgrows what there is.

    A text may be longer than all texts at hand by some times what the caller
    gave, so variables can gather texts turn by turn but not double.
    """
    if isinstance(value, str) and len(value) > FREE:
        longest = max((len(v) for v in env.values() if isinstance(v, str)), default=0)
        given = sum(len(t) for v in env.values() if isinstance(v, Mapping) for t in v.values() if isinstance(t, str))
        if len(value) > FREE + longest + GROWTH * given:
            raise TemplateError(f"{name} grows too fast")
    return value


def _statement(node: Any, filters: Mapping[str, Callable[[Any], Any]], marked: bool) -> Callable[[Env], Pieces]:
    """The closure of a statement; it yields pieces of text, and whether each is under a generation marker."""
    if isinstance(node, Print):
        if isinstance(node.what, Const):
            piece = (shown(node.what.value), marked)

            def literal(env: Env) -> Pieces:
                yield piece

            return literal
        value = _value(node.what, filters)

        def output(env: Env) -> Pieces:
            yield shown(value(env)), marked

        return output
    if isinstance(node, Set):
        value = _value(node.what, filters)

        def assign(env: Env) -> Pieces:
            env[node.name] = _grown(node.name, value(env), env)
            yield from ()

        return assign
    if isinstance(node, Generation):
        return _block(node.body, filters, True)
    if isinstance(node, If):
        arms = [(_value(test, filters), _block(body, filters, marked)) for test, body in node.tests]

        def choose(env: Env) -> Pieces:
            for test, block in arms:
                if test(env):
                    yield from block(env)
                    return

        return choose
    over, block = _value(node.over, filters), _block(node.body, filters, marked)

    def loop(env: Env) -> Pieces:
        """One item is read ahead, for loop.last; the rest is left in the iterator."""
        items = iter(over(env) or ())
        item, inner, missing = next(items, env), dict(env), env
        k = 0
        while item is not missing:
            ahead = next(items, missing)
            inner[node.name] = item
            inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": ahead is missing}
            yield from block(inner)
            item, k = ahead, k + 1

    return loop


def _block(body: tuple, filters: Mapping[str, Callable[[Any], Any]], marked: bool) -> Callable[[Env], Pieces]:
    statements = [_statement(node, filters, marked) for node in body]

    def run(env: Env) -> Pieces:
        for statement in statements:
            yield from statement(env)

    return run


@dataclass(frozen=True)
class Template:
    """A template with its control strings, which are escaped inside texts.

    A backslash goes after the first character of every control string in a
    text, wherever one begins, and backslashes are doubled.  So no text holds
    a control string, and taking one backslash away from each pair restores it.
    """

    source: str
    controls: tuple[str, ...] = ()
    filters: Mapping[str, Callable[[Any], Any]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise TemplateError("a control string has two characters at least and no backslash")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        if not self.controls:
            return text
        begins = "|".join(re.escape(c) for c in self.controls)
        return re.sub(rf"(?=(?:{begins}))(.)", r"\1\\", text, flags=re.S)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text

    def compiled(self) -> Callable[[Env], Pieces]:
        """The closure of the whole template."""
        filters = {
            "trim": lambda v: shown(v).strip(),
            "upper": lambda v: shown(v).upper(),
            "lower": lambda v: shown(v).lower(),
            "length": lambda v: len(v) if v is not None else 0,
            "string": shown,
            "escape": lambda v: self.escape(shown(v)),
            **self.filters,
        }
        return _block(fold(parse(self.source), filters), filters, False)
