"""Compiler of a sandboxed template language for conversations.

``parse`` turns a template into a syntax tree of tuples, ``fold`` evaluates constant expressions, drops branches that
cannot be taken and joins neighbouring literals, and ``compile_template`` turns the tree into nested Python closures.
A compiled template yields pieces ``(text, marked)``; ``marked`` is true inside ``{% generation %}``. Loops read their
items one at a time, so a conversation of any length renders in bounded memory.

    {{ expression }}
    {% for name in expression %} ... {% endfor %}      loop.first, loop.last and loop.index inside
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}

Expressions: strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` (keys of mappings only), ``== != and or
not ~ +``, parentheses and the filters of ``FILTERS``. There are no calls, attributes or imports, and names that begin
with an underscore are refused. A missing name or key is none, which renders as nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Piece = tuple[str, bool]
Render = Callable[[dict[str, Any], bool], Iterator[Piece]]
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: show(v).strip(),
    "upper": lambda v: show(v).upper(),
    "lower": lambda v: show(v).lower(),
    "length": lambda v: len(v or ""),
}
TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.~+|()\[\]]))", re.S)
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is not in the language."""


def show(value: Any) -> str:
    return "" if value is None else str(value)


# ---- expressions ---------------------------------------------------------------------


class Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str, filters: Iterable[str]):
        self.tokens, self.at, self.filters = [], 0, set(filters)
        place = 0
        while source[place:].strip():
            found = TOKEN.match(source, place)
            if not found:
                raise TemplateError(f"unexpected text: {source[place:]!r}")
            kind = found.lastindex
            self.tokens.append(("string" if kind == 1 else "number" if kind == 2 else "name" if kind == 3 else "sign", found[kind]))
            place = found.end()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name" or self.tokens[self.at][1].startswith("_"):
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negation()
        while self.take("and"):
            tree = ("and", tree, self.negation())
        return tree

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        tree = self.joined()
        while sign := self.take("==", "!="):
            tree = (sign, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while sign := self.take("~", "+"):
            tree = (sign, tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.primary()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                tree = ("filter", name, tree)
            elif self.take("."):
                tree = ("key", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("key", tree, self.either())
                self.need("]")
            else:
                return tree

    def primary(self) -> tuple:
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, value = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return ("const", int(value))
        name = self.name()
        return ("const", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else ("name", name)


# ---- statements ----------------------------------------------------------------------


def parse(source: str, filters: Iterable[str] = FILTERS) -> tuple:
    """Syntax tree ``("block", [nodes])``."""
    parts: list[tuple[str, str]] = []
    place = 0
    for tag in TAG.finditer(source):
        parts += [("text", source[place : tag.start()])] if tag.start() > place else []
        parts.append(("expr", tag[1]) if tag[1] is not None else ("tag", tag[2].strip()))
        place = tag.end()
    parts += [("text", source[place:])] if place < len(source) else []
    tree, rest = parse_block(parts, 0, filters, ())
    if rest < len(parts):
        raise TemplateError(f"unexpected {parts[rest][1]!r}")
    return tree


def parse_block(parts: list[tuple[str, str]], at: int, filters: Iterable[str], ends: tuple[str, ...]) -> tuple[tuple, int]:
    nodes: list[tuple] = []
    while at < len(parts):
        kind, body = parts[at]
        word, _, rest = body.partition(" ") if kind == "tag" else ("", "", "")
        if kind == "tag" and word in ends:
            return ("block", nodes), at
        at += 1
        if kind == "text":
            nodes.append(("text", body))
        elif kind == "expr":
            nodes.append(("put", Expression(body, filters).whole()))
        elif word == "for" and (m := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)):
            inner, at = parse_block(parts, at, filters, ("endfor",))
            nodes.append(("for", m[1], Expression(m[2], filters).whole(), inner))
            at = closed(parts, at, "endfor")
        elif word == "if":
            node, at = parse_if(parts, at, filters, rest)
            nodes.append(node)
        elif word == "set" and (m := re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.S)):
            nodes.append(("set", m[1], Expression(m[2], filters).whole()))
        elif word == "generation" and not rest:
            inner, at = parse_block(parts, at, filters, ("endgeneration",))
            nodes.append(("generation", inner))
            at = closed(parts, at, "endgeneration")
        else:
            raise TemplateError(f"unknown tag {body!r}")
    return ("block", nodes), at


def parse_if(parts: list[tuple[str, str]], at: int, filters: Iterable[str], test: str) -> tuple[tuple, int]:
    inner, at = parse_block(parts, at, filters, ("elif", "else", "endif"))
    word, _, rest = parts[at][1].partition(" ") if at < len(parts) else ("", "", "")
    if word == "elif":
        other, at = parse_if(parts, at + 1, filters, rest)
        return ("if", Expression(test, filters).whole(), inner, other), at
    other = ("block", [])
    if word == "else":
        other, at = parse_block(parts, at + 1, filters, ("endif",))
    return ("if", Expression(test, filters).whole(), inner, other), closed(parts, at, "endif")


def closed(parts: list[tuple[str, str]], at: int, end: str) -> int:
    if at >= len(parts) or parts[at][1] != end:
        raise TemplateError(f"{end} expected")
    return at + 1


# ---- folding -------------------------------------------------------------------------


def fold(tree: tuple, filters: dict[str, Callable[[Any], Any]] = FILTERS) -> tuple:
    """An equal tree in which nothing constant is left to compute."""
    kind = tree[0]
    if kind == "block":
        nodes: list[tuple] = []
        for node in (fold(n, filters) for n in tree[1]):
            for n in node[1] if node[0] == "block" else [node]:
                if n[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + n[1])
                elif n != ("text", ""):
                    nodes.append(n)
        return ("block", nodes)
    if kind == "put":
        value = fold(tree[1], filters)
        return ("text", show(value[1])) if value[0] == "const" else ("put", value)
    if kind == "if":
        test = fold(tree[1], filters)
        if test[0] == "const":
            return fold(tree[2] if test[1] else tree[3], filters)
        return ("if", test, fold(tree[2], filters), fold(tree[3], filters))
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "set":
        return ("set", tree[1], fold(tree[2], filters))
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind in ("const", "name", "text"):
        return tree
    parts = [fold(p, filters) if isinstance(p, tuple) else p for p in tree[1:]]
    folded = (kind, *parts)
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        return ("const", evaluator(folded, filters)({}))
    return folded


# ---- closures ------------------------------------------------------------------------


def evaluator(tree: tuple, filters: dict[str, Callable[[Any], Any]]) -> Callable[[dict[str, Any]], Any]:
    kind = tree[0]
    if kind == "const":
        return lambda names, value=tree[1]: value
    if kind == "name":
        return lambda names, name=tree[1]: names.get(name)
    if kind == "filter":
        inner, apply = evaluator(tree[2], filters), filters[tree[1]]
        return lambda names: apply(inner(names))
    if kind == "not":
        inner = evaluator(tree[1], filters)
        return lambda names: not inner(names)
    left, right = evaluator(tree[1], filters), evaluator(tree[2], filters)
    if kind == "key":
        def key(names: dict[str, Any]) -> Any:
            held = left(names)
            return held.get(right(names)) if isinstance(held, dict) else None

        return key
    if kind == "and":
        return lambda names: left(names) and right(names)
    if kind == "or":
        return lambda names: left(names) or right(names)
    if kind == "==":
        return lambda names: left(names) == right(names)
    if kind == "!=":
        return lambda names: left(names) != right(names)
    return lambda names: show(left(names)) + show(right(names))


def renderer(tree: tuple, filters: dict[str, Callable[[Any], Any]]) -> Render:
    kind = tree[0]
    if kind == "text":
        return lambda names, marked, text=tree[1]: iter(((text, marked),))
    if kind == "put":
        value = evaluator(tree[1], filters)
        return lambda names, marked: iter(((show(value(names)), marked),))
    if kind == "block":
        inner = [renderer(n, filters) for n in tree[1]]

        def block(names: dict[str, Any], marked: bool) -> Iterator[Piece]:
            for render in inner:
                yield from render(names, marked)

        return block
    if kind == "if":
        test, then, other = evaluator(tree[1], filters), renderer(tree[2], filters), renderer(tree[3], filters)
        return lambda names, marked: then(names, marked) if test(names) else other(names, marked)
    if kind == "generation":
        body = renderer(tree[1], filters)
        return lambda names, marked: body(names, True)
    if kind == "set":
        value = evaluator(tree[2], filters)

        def assign(names: dict[str, Any], marked: bool) -> Iterator[Piece]:
            names[tree[1]] = value(names)
            return iter(())

        return assign
    items, body = evaluator(tree[2], filters), renderer(tree[3], filters)

    def loop(names: dict[str, Any], marked: bool) -> Iterator[Piece]:
        coming, none = iter(items(names) or ()), object()
        item, index = next(coming, none), 0
        while item is not none:
            after, index = next(coming, none), index + 1
            yield from body({**names, tree[1]: item, "loop": {"first": index == 1, "last": after is none, "index": index}}, marked)
            item = after

    return loop


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[[dict[str, Any]], Iterator[Piece]]:
    """A function from names to pieces (text, marked). ``filters`` extend ``FILTERS``."""
    known = FILTERS | (filters or {})
    render = renderer(fold(parse(source, known), known), known)
    return lambda names: render(dict(names), False)
