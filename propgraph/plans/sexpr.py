"""S-expression queries: define-query with typed parameters, let, set!, return, node-set operations and walks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.model import PropertyGraph
from propgraph.operators import sets, walk


def parse(text: str) -> list:
    """Nested lists of symbols, strings (as ('str', value)) and numbers."""
    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[()\[\]]|[^\s()\[\]]+', re.sub(r";[^\n]*", "", text))
    stack: list[list] = [[]]
    for t in tokens:
        if t in "([":
            stack.append([])
        elif t in ")]":
            if len(stack) < 2:
                raise SyntaxError("a closing bracket too many")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(("str", t[1:-1]) if t[0] == '"' else int(t) if re.fullmatch(r"-?\d+", t) else t)
    if len(stack) > 1:
        raise SyntaxError("a closing bracket is missing")
    return stack[0]


class _Return(Exception):
    def __init__(self, value):
        self.value = value


def run(graph: PropertyGraph, text: str, **arguments) -> DataFrame | object:
    """Evaluates the last query of a text; ``arguments`` are its parameters: graph ones are filled in.

    Its value is what ``return`` names, or the last expression.
    """
    value = None
    for form in parse(text):
        if isinstance(form, list) and form and form[0] == "define-query":
            head, body = form[1], form[2:]
            scope: dict[str, object] = {}
            for p in head[1:]:
                name, kind = (p[0], p[-1]) if isinstance(p, list) else (p, "node")
                scope[name] = graph if kind == "graph" else arguments[name]
            try:
                for x in body:
                    value = _value(graph, x, scope)
            except _Return as done:
                value = done.value
        else:
            value = _value(graph, form, {})
    return value


def _set_of(graph: PropertyGraph, value) -> DataFrame:
    return value if isinstance(value, DataFrame) else sets.of(graph.spark, value if isinstance(value, (list, tuple)) else [value])


def _value(graph: PropertyGraph, form, scope: dict):
    if isinstance(form, tuple):
        return form[1]
    if isinstance(form, int):
        return form
    if isinstance(form, str):
        if form in ("#t", "#f"):
            return form == "#t"
        if form not in scope:
            raise NameError(f"{form} is not defined")
        return scope[form]
    name, rest = form[0], form[1:]
    if name == "let":
        inner = dict(scope) | {k: None for k, _ in rest[0]}
        for k, v in rest[0]:
            inner[k] = _value(graph, v, scope)
        out = None
        for x in rest[1:]:
            out = _value(graph, x, inner)
        return out
    if name == "set!":
        scope[rest[0]] = _value(graph, rest[1], scope)
        return scope[rest[0]]
    if name == "return":
        raise _Return(_value(graph, rest[0], scope))
    if name == "begin":
        return [_value(graph, x, scope) for x in rest][-1]
    args = [_value(graph, x, scope) for x in rest]
    if name == "bitset:from":
        return _set_of(graph, args[0])
    if name in ("bitset:and-not", "bitset:and", "bitset:or"):
        return {"bitset:and-not": sets.difference, "bitset:and": sets.intersect, "bitset:or": sets.union}[name](args[0], args[1])
    if name == "bitset:count":
        return args[0].agg(F.countDistinct("id")).head()[0]
    if name.endswith(":walk-csr"):
        return walk.walk(graph.edges(args[-1]), _set_of(graph, args[-2]))
    if name.endswith(":walk-csc"):
        return walk.walk_back(graph.edges(args[-1]), _set_of(graph, args[-2]))
    if name in ("csr-walk", "csc-walk"):  # from a set, or from all nodes of the relation's end
        r = graph.relation(args[0])
        start = _set_of(graph, args[1]) if len(args) > 1 else graph.nodes(r.source if name == "csr-walk" else r.target).select("id")
        return walk.walk(r.edges, start) if name == "csr-walk" else walk.walk_back(r.edges, start)
    raise NameError(f"{name} is not known")
