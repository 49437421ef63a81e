"""A small sandboxed template language, compiled to Python closures.

Text with `{{ expression }}`, `{% for name in expression %}`, `{% if %}` / `{% elif %}` /
`{% else %}`, `{% generation %}` (its output is marked) and `{# remarks #}`.  Expressions have
strings, integers, true, false, none, names, `.key` and `['key']` on mappings, `==`, `!=`,
`in`, `not`, `and`, `or`, `~` (joins strings) and `| filter`.  Nothing can be called but the
filters given to the compiler, and no attribute of a Python object can be reached.

The source becomes a syntax tree, constant parts of the tree are folded, and each node then
becomes one closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


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
class Apply:
    """An operator or filter on its arguments."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[|.~()\[\]]))""")
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


def as_text(value: Any) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "~": lambda a, b: as_text(a) + as_text(b),
    "not": lambda a: not a,
}


class _Expression:
    """Recursive descent over the tokens of one expression; weakest operators first."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            found = _TOKENS.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(found.groups())
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        if self.at == len(self.tokens):
            return None
        _, _, word, sign = self.tokens[self.at]
        return word or sign

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def whole(self):
        value = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]}")
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while (sign := self.peek()) in ("==", "!=", "in"):
            self.at += 1
            left = Apply(sign, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while self.take("~"):
            left = Apply("~", (left, self.filtered()))
        return left

    def filtered(self):
        value = self.reached()
        while self.take("|"):
            value = Apply("|" + self.word(), (value,))
        return value

    def word(self) -> str:
        if self.at == len(self.tokens) or not self.tokens[self.at][2]:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][2]

    def reached(self):
        value = self.single()
        while True:
            if self.take("."):
                value = Item(value, Const(self.word()))
            elif self.take("["):
                value = Item(value, self.either())
                self.need("]")
            else:
                return value

    def single(self):
        if self.take("("):
            value = self.either()
            self.need(")")
            return value
        if self.at == len(self.tokens):
            raise TemplateError("an expression is missing")
        string, number, word, sign = self.tokens[self.at]
        self.at += 1
        if string is not None:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), string[1:-1], flags=re.S))
        if number is not None:
            return Const(int(number))
        if word is None:
            raise TemplateError(f"unexpected {sign!r}")
        return Const(_WORDS[word]) if word in _WORDS else Name(word)


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts, at = [], 0
    for found in _PARTS.finditer(source):
        if found.start() > at:
            parts.append(("text", source[at : found.start()]))
        if found[1] is not None:
            parts.append(("output", found[1]))
        elif found[2] is not None:
            parts.append(("tag", found[2].strip()))
        at = found.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        nodes = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Text(text))
            elif kind == "output":
                nodes.append(Output(_Expression(text).whole()))
            else:
                head, _, rest = text.partition(" ")
                if head in ends:
                    return tuple(nodes), text
                if head == "for":
                    name, sep, over = rest.partition(" in ")
                    if not sep or not name.strip().isidentifier():
                        raise TemplateError(f"cannot read {text!r}")
                    nodes.append(For(name.strip(), _Expression(over).whole(), body("endfor")[0]))
                elif head == "if":
                    nodes.append(branch(rest))
                elif head == "generation":
                    nodes.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    def branch(test: str) -> If:
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), then, (branch(end[4:]),))
        return If(_Expression(test).whole(), then, body("endif")[0] if end == "else" else ())

    return body()[0]


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The tree with constant parts computed: operators and filters on constants, constant output, decided branches, neighbouring text."""
    if isinstance(node, tuple):
        out: list = []
        for part in (fold(n, filters) for n in node):
            for x in part if isinstance(part, tuple) else (part,):
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif x != Text(""):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        if node.what in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.what == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            call = filters[node.what[1:]] if node.what[0] == "|" else OPERATORS[node.what]
            return Const(call(*(a.value for a in args)))
        return Apply(node.what, args)
    if isinstance(node, Output):
        value = fold(node.value, filters)
        return Text(as_text(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, If):
        test, then, other = fold(node.test, filters), fold(node.then, filters), fold(node.other, filters)
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


@dataclass
class Rendered:
    """Pieces of output, and (start, end) of what the generation marks hold, in code points."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    marked: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda names, v=node.value: v
    if isinstance(node, Name):

        def look(names: dict, name=node.name) -> Any:
            if name not in names:
                raise TemplateError(f"{name} is not defined")
            return names[name]

        return look
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def reach(names: dict) -> Any:
            held = of(names)
            if not isinstance(held, dict):
                raise TemplateError("only mappings have keys")
            return held.get(key(names))

        return reach
    args = [_value(a, filters) for a in node.args]
    if node.what == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.what == "or":
        return lambda names: args[0](names) or args[1](names)
    call = filters[node.what[1:]] if node.what[0] == "|" else OPERATORS[node.what]
    return (lambda names: call(args[0](names))) if len(args) == 1 else (lambda names: call(args[0](names), args[1](names)))


def _write(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict, Rendered], None]:
    if isinstance(node, tuple):
        steps = [_write(n, filters) for n in node]

        def run(names: dict, out: Rendered) -> None:
            for step in steps:
                step(names, out)

        return run
    if isinstance(node, Text):
        return lambda names, out, text=node.text: out.add(text)
    if isinstance(node, Output):
        value = _value(node.value, filters)
        return lambda names, out: out.add(as_text(value(names)))
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _write(node.then, filters), _write(node.other, filters)
        return lambda names, out: (then if test(names) else other)(names, out)
    body = _write(node.body, filters)
    if isinstance(node, Generation):

        def mark(names: dict, out: Rendered) -> None:
            start = out.length
            body(names, out)
            if out.length > start:
                out.marked.append((start, out.length))

        return mark
    over, name = _value(node.over, filters), node.name

    def loop(names: dict, out: Rendered) -> None:
        held = over(names)
        if not isinstance(held, (list, tuple)):
            raise TemplateError("only lists can be looped over")
        for i, item in enumerate(held):
            body({**names, name: item, "loop": {"index": i + 1, "first": i == 0, "last": i + 1 == len(held)}}, out)

    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's names that returns its text and the marked spans."""
    tree = parse(source)

    def check(node: Any) -> None:
        if isinstance(node, Apply) and node.what[0] == "|" and node.what[1:] not in filters:
            raise TemplateError(f"no filter {node.what[1:]}")
        for part in node if isinstance(node, tuple) else vars(node).values():
            if isinstance(part, tuple) or hasattr(part, "__dataclass_fields__"):
                check(part)

    check(tree)
    write = _write(fold(tree, filters), filters)

    def render(**names: Any) -> tuple[str, list[tuple[int, int]]]:
        out = Rendered()
        write(names, out)
        return "".join(out.pieces), out.marked

    return render
