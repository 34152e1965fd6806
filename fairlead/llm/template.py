"""A small sandboxed template language: source -> syntax tree -> folded tree -> Python closures.

    text                         printed as it is
    {{ expression }}             printed
    {% set name = expression %}
    {% for name in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}     what a model is to produce: the loss mask

Expressions are literals, names, `name.field`, `+`, `==`, `!=`, `and`, `or`, `not`, parentheses and `expr | filter`.
There are no calls, no attributes of objects, no imports: a field is an entry of a mapping, a filter one of those that
the compiler was given. Rendering yields pieces as they come, so that a long conversation is never held as one text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

Piece = tuple[str, bool]  # text, and whether it is under the loss mask
Scope = dict[str, object]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass
class Print:
    value: object


@dataclass
class Set:
    name: str
    value: object


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class If:
    branches: list[tuple[object, list]] = field(default_factory=list)


@dataclass
class Generation:
    body: list


TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.DOTALL)
TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[+|.()]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Expression:
    """Recursive descent: or < and < not < comparison < sum < filter < field."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at:]}")
        return tree

    def either(self):
        tree = self.both()
        while self.peek("or"):
            self.take()
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.peek("and"):
            self.take()
            tree = Op("and", (tree, self.negated()))
        return tree

    def negated(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.negated(),))
        tree = self.total()
        while self.peek("==", "!="):
            tree = Op(self.take()[1], (tree, self.total()))
        return tree

    def total(self):
        tree = self.filtered()
        while self.peek("+"):
            self.take()
            tree = Op("+", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.single()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if kind != "name":
                raise TemplateError(f"not a filter: {name!r}")
            tree = Filter(tree, name)
        return tree

    def single(self):
        kind, text = self.take()
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "int":
            return Const(int(text))
        if text == "(":
            tree = self.either()
            if self.take()[1] != ")":
                raise TemplateError("a parenthesis is not closed")
        elif kind == "name" and text in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[text])
        elif kind == "name":
            tree = Name(text)
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek("."):
            self.take()
            kind, name = self.take()
            if kind != "name":
                raise TemplateError(f"not a field: {name!r}")
            tree = Field(tree, name)
        return tree


def parse(source: str) -> list:
    """The syntax tree: a list of text constants and statement nodes."""
    top: list = []
    open_blocks: list[tuple[str, object, list]] = []
    body, done = top, 0
    for m in TAG.finditer(source):
        if m.start() > done:
            body.append(Print(Const(source[done:m.start()])))
        done = m.end()
        if m[1] is not None:
            body.append(Print(Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"set needs a name and a value: {rest!r}")
            body.append(Set(name.strip(), Expression(value).whole()))
        elif word == "for":
            name, _, over = rest.strip().partition(" in ")
            node = For(name.strip(), Expression(over).whole(), [])
            body.append(node)
            open_blocks.append(("endfor", node, body))
            body = node.body
        elif word == "if":
            node = If([(Expression(rest).whole(), [])])
            body.append(node)
            open_blocks.append(("endif", node, body))
            body = node.branches[-1][1]
        elif word in ("elif", "else"):
            if not open_blocks or open_blocks[-1][0] != "endif":
                raise TemplateError(f"{word} without if")
            node = open_blocks[-1][1]
            node.branches.append((Expression(rest).whole() if word == "elif" else Const(True), []))
            body = node.branches[-1][1]
        elif word == "generation":
            node = Generation([])
            body.append(node)
            open_blocks.append(("endgeneration", node, body))
            body = node.body
        elif open_blocks and word == open_blocks[-1][0]:
            body = open_blocks.pop()[2]
        else:
            raise TemplateError(f"unknown or misplaced tag: {word!r}")
    if open_blocks:
        raise TemplateError(f"missing {open_blocks[-1][0]}")
    if done < len(source):
        body.append(Print(Const(source[done:])))
    return top


Filters = Mapping[str, Callable[[object], object]]


def fold(tree, filters: Filters):
    """Constants are computed now, branches that can't be taken go, and neighbouring texts become one."""
    if isinstance(tree, list):
        out: list = []
        for node in map(lambda n: fold(n, filters), tree):
            for n in node if isinstance(node, list) else [node]:
                if isinstance(n, Print) and isinstance(n.value, Const) and out and isinstance(out[-1], Print) and isinstance(out[-1].value, Const):
                    out[-1] = Print(Const(shown(out[-1].value.value) + shown(n.value.value)))
                else:
                    out.append(n)
        return out
    if isinstance(tree, Print):
        return Print(fold(tree.value, filters))
    if isinstance(tree, Set):
        return Set(tree.name, fold(tree.value, filters))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.over, filters), fold(tree.body, filters))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body, filters))
    if isinstance(tree, If):
        left = []
        for test, body in tree.branches:
            test = fold(test, filters)
            if isinstance(test, Const) and not test.value:
                continue
            left.append((test, fold(body, filters)))
            if isinstance(test, Const):
                break
        return [] if not left else left[0][1] if isinstance(left[0][0], Const) else If(left)
    if isinstance(tree, Field):
        return Field(fold(tree.of, filters), tree.name)
    if isinstance(tree, Filter):
        of = fold(tree.of, filters)
        if tree.name not in filters:
            raise TemplateError(f"unknown filter: {tree.name!r}")
        return Const(filters[tree.name](of.value)) if isinstance(of, Const) else Filter(of, tree.name)
    if isinstance(tree, Op):
        args = tuple(fold(a, filters) for a in tree.args)
        return Const(OPS[tree.kind](*[lambda a=a: a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(tree.kind, args)
    return tree


def plus(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else shown(a) + shown(b)


#: Arguments come as functions, as `and` and `or` may not need the second.
OPS: dict[str, Callable] = {
    "or": lambda a, b: a() or b(), "and": lambda a, b: a() and b(), "not": lambda a: not a(),
    "==": lambda a, b: a() == b(), "!=": lambda a, b: a() != b(), "+": lambda a, b: plus(a(), b()),
}


def shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def value_of(tree, filters: Filters) -> Callable[[Scope], object]:
    if isinstance(tree, Const):
        return lambda scope, v=tree.value: v
    if isinstance(tree, Name):
        return lambda scope, n=tree.name: scope.get(n)
    if isinstance(tree, Field):
        of = value_of(tree.of, filters)
        return lambda scope, n=tree.name: v.get(n) if isinstance(v := of(scope), Mapping) else None
    if isinstance(tree, Filter):
        of = value_of(tree.of, filters)
        return lambda scope, f=filters[tree.name]: f(of(scope))
    run, args = OPS[tree.kind], [value_of(a, filters) for a in tree.args]
    if len(args) == 1:
        return lambda scope, a=args[0]: run(lambda: a(scope))
    return lambda scope, a=args[0], b=args[1]: run(lambda: a(scope), lambda: b(scope))


def closure(node, filters: Filters, masked: bool) -> Callable[[Scope], Iterator[Piece]]:
    if isinstance(node, list):
        parts = [closure(n, filters, masked) for n in node]

        def run_all(scope):
            for part in parts:
                yield from part(scope)

        return run_all
    if isinstance(node, Print):
        value = value_of(node.value, filters)

        def show(scope):
            if text := shown(value(scope)):
                yield text, masked

        return show
    if isinstance(node, Set):
        value = value_of(node.value, filters)

        def put(scope):
            scope[node.name] = value(scope)
            return iter(())

        return put
    if isinstance(node, For):
        over, body = value_of(node.over, filters), closure(node.body, filters, masked)

        def loop(scope):
            for item in over(scope) or ():
                scope[node.name] = item
                yield from body(scope)

        return loop
    if isinstance(node, Generation):
        return closure(node.body, filters, True)
    branches = [(value_of(test, filters), closure(body, filters, masked)) for test, body in node.branches]

    def choose(scope):
        for test, body in branches:
            if test(scope):
                yield from body(scope)
                return

    return choose


def compile_template(source: str, filters: Filters) -> Callable[..., Iterator[Piece]]:
    """A function of the template's variables that yields (text, under the loss mask) pieces. A variable may be an
    iterator, which is then read as the pieces are asked for."""
    run = closure(fold(parse(source), filters), filters, False)
    return lambda **variables: run(dict(variables))


def spans(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text, and the code point ranges under the loss mask."""
    out, marked, size = [], [], 0
    for text, masked in pieces:
        if masked and marked and marked[-1][1] == size:
            marked[-1] = marked[-1][0], size + len(text)
        elif masked:
            marked.append((size, size + len(text)))
        out.append(text)
        size += len(text)
    return "".join(out), marked
