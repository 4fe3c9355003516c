"""The request language ``[domain=[…],variable=[…],operation=[…]]``.

Values are quoted strings, numbers, true and false, objects and lists. Keys are case-insensitive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from cubelark.cube import CubeError
from cubelark.operators.subset import Domain, Range, axis_letter

TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)|(?P<word>[A-Za-z_][\w.]*)|(?P<mark>[\[\]{}:,;=|]))""")


class _Reader:
    def __init__(self, text: str):
        if "]]>" in text:
            raise CubeError("a request must not contain ]]>")
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            found = TOKEN.match(text, at)
            if not found:
                raise CubeError(f"can't read the request at: {text[at : at + 20]!r}")
            self.tokens.append((found.lastgroup, found.group(found.lastgroup)))
            at = found.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, *marks: str) -> str:
        if self.at >= len(self.tokens) or (marks and self.peek() not in marks):
            raise CubeError(f"expected {' or '.join(marks) or 'more'} in the request, found {self.peek() or 'its end'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def value(self):
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if text == "{":
            return self.object()
        if text == "[":
            return self.sequence("[", "]", self.value)
        self.take()
        if kind == "text":
            return text[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        if kind == "number":
            return float(text) if re.search("[.eE]", text) else int(text)
        if text in ("true", "false"):
            return text == "true"
        raise CubeError(f"not a value: {text or 'end of request'}")

    def sequence(self, start: str, end: str, item) -> list:
        self.take(start)
        out = []
        while self.peek() != end:
            out.append(item())
            if self.peek() != end:
                self.take(",", ";")
        self.take(end)
        return out

    def member(self) -> tuple[str, object]:
        key = self.take().strip('"').lower()
        self.take(":")
        return key, self.value()

    def object(self) -> dict:
        return dict(self.sequence("{", "}", self.member))

    def section(self) -> tuple[str, list[dict]]:
        key = self.take().strip('"').lower()
        self.take("=")
        return key, [self.object()] if self.peek() == "{" else self.sequence("[", "]", self.object)

    def request(self) -> dict[str, list[dict]]:
        out = dict(self.sequence("[", "]", self.section))
        if self.at < len(self.tokens):
            raise CubeError(f"more follows the request: {self.peek()}")
        return out


@dataclass(frozen=True)
class Variable:
    """An input: ``alias`` is what operations call it."""

    alias: str
    name: str
    uri: str
    domain: str = ""
    cache: bool | None = None


@dataclass(frozen=True)
class Node:
    """An operation; with an ``id`` it is an intermediate, else a product called ``result``."""

    name: str
    inputs: tuple[str, ...]
    domains: tuple[str, ...] = ()
    id: str = ""
    result: str = ""
    options: dict = field(default_factory=dict)

    @property
    def rid(self) -> str:
        return self.id or self.result


@dataclass(frozen=True)
class Request:
    domains: dict[str, Domain]
    variables: dict[str, Variable]
    operations: list[Node]


def _domain(o: dict) -> Domain:
    ranges, rest = [], []
    for key, value in o.items():
        letter = axis_letter(key)
        if key in ("name", "id", "mask"):
            continue
        if letter and isinstance(value, dict):
            system = str(value.get("system", value.get("crs", "values"))).lower()
            if not system.startswith(("val", "ind", "timestamps")):
                raise CubeError(f"unknown system {system}")
            start = value.get("start")
            if start is None:
                raise CubeError(f"axis {key} has no start")
            ranges.append(Range(letter, start, value.get("end", start), "indices" if system.startswith("ind") else "values"))
        elif letter:
            ranges.append(Range(letter, value, value))
        else:
            rest.append((key, str(value)))
    name = str(o.get("name", o.get("id", "")))
    if not name:
        raise CubeError("a domain needs a name")
    return Domain(name, tuple(ranges), o.get("mask"), tuple(rest))


def _variables(o: dict, i: int) -> list[Variable]:
    uri = str(o.get("uri", o.get("url", o.get("collection", o.get("path", "")))))
    if not uri:
        raise CubeError("a variable needs a uri")
    names = [n.strip() for n in str(o.get("name", o.get("id", "*"))).split(",")]
    out = []
    for k, n in enumerate(names):
        name, _, alias = n.replace("|", ":").partition(":")
        out.append(Variable(alias or (f"v{i}_{k}" if name == "*" else name), name, uri, str(o.get("domain", "")), o.get("cache")))
    return out


def parse(text: str) -> Request:
    """Reads and validates a request: unknown domains and inputs, and equal names, are errors."""
    return build(_Reader(text).request())


def build(sections: dict[str, list[dict]]) -> Request:
    """A request from its sections as Python lists of dicts."""
    unknown = set(sections) - {"domain", "variable", "operation", "grid"}
    if unknown:
        raise CubeError(f"unknown section {', '.join(sorted(unknown))}")
    domains = {d.name: d for d in map(_domain, sections.get("domain", []))}
    variables: dict[str, Variable] = {}
    for i, o in enumerate(sections.get("variable", [])):
        for v in _variables(o, i):
            if v.alias in variables:
                raise CubeError(f"two variables are called {v.alias}")
            variables[v.alias] = v
    nodes = []
    for i, o in enumerate(sections.get("operation", [])):
        if "name" not in o:
            raise CubeError("an operation needs a name")
        inputs = o.get("input")
        inputs = list(variables) if inputs is None else [x.strip() for x in inputs.split(",")] if isinstance(inputs, str) else [str(x) for x in inputs]
        where = tuple(x.strip() for x in str(o.get("domain", "")).split(",") if x.strip())
        options = {k: v for k, v in o.items() if k not in ("name", "input", "domain", "id", "result")}
        result = str(o.get("result", "")) or ("" if o.get("id") else f"{o['name'].split('.')[-1]}-{i}")
        nodes.append(Node(str(o["name"]), tuple(inputs), where, str(o.get("id", "")), result, options))
    known = set(variables) | {n.id for n in nodes if n.id}
    names = [n.rid for n in nodes]
    if len(set(names)) < len(names) or set(names) & set(variables):
        raise CubeError("two nodes have the same name")
    for n in nodes:
        for x in n.inputs:
            if x not in known:
                raise CubeError(f"operation {n.name}: unknown input {x}")
        for d in n.domains:
            if d not in domains:
                raise CubeError(f"operation {n.name}: unknown domain {d}")
    for v in variables.values():
        if v.domain and v.domain not in domains:
            raise CubeError(f"variable {v.name}: unknown domain {v.domain}")
    return Request(domains, variables, nodes)
