"""The vector language: functions over graphs with assignments, loops, node sets, vectors and semiring products.

``x: e`` assigns, ``x+: e`` and ``x-: e`` update, ``v[S]: e`` assigns within a set. ``until[c] { }``,
``while c { }``, ``for i in a..b { }``, ``return e``, ``c ? a : b``. ``g @[S; "R"]`` walks, ``g @[v; +*]``
multiplies (also ``min+``, ``maxmin``, ``minmin``). Sets take ``| & &~``, vectors and numbers ``+ - * /``;
words before a value apply to it: sum, abs, count, sqrt, l2_norm, bitset, empty, min, max.
A slash that begins a line or follows two spaces begins a comment. Vectors that a loop assigns are
written to the shared folder, so plans do not grow.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.model import PropertyGraph
from propgraph.operators import sets, structure, vectors, walk
from propgraph.plans.staging import staged

_TOKEN = re.compile(r'\s*("[^"]*"|\d+\.\d+(?:[eE]-?\d+)?|\d+(?!\.\d)|\.\.|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|&~|<=|>=|==|!=|[-+]:|@\[|[-+*/&|<>?:;,(){}\[\]])')
RINGS = {"+*": "plus_times", "min+": "min_plus", "maxmin": "max_min", "minmin": "min_min", "|&": "bool"}
WORDS = {"sum", "abs", "count", "sqrt", "l2_norm", "bitset", "empty", "not_empty", "min", "max", "vector", "tril"}
INFINITY = float("inf")


def _tokens(text: str) -> list[str]:
    text = "\n".join(re.sub(r"(^\s*|\s{2,}|\t)/(\s.*|=.*)?$", "", line) for line in text.splitlines())
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"cannot read {text[at:at + 20]!r}")
        out.append(m[1])
        at = m.end()
    return out


class _Parser:
    """Tokens to nested tuples."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise SyntaxError(f"expected {want or 'more'}, found {got!r}")
        self.at += 1
        return got

    def program(self) -> dict[str, tuple]:
        out = {}
        while self.peek():
            self.take("fn")
            name, params = self.take(), []
            self.take("(")
            while self.peek() != ")":
                params.append(self.take())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            out[name] = (params, self.block())
        return out

    def block(self) -> list:
        self.take("{")
        out = []
        while self.peek() != "}":
            out.append(self.statement())
        self.take("}")
        return out

    def statement(self) -> tuple:
        word = self.peek()
        if word == "return":
            self.take()
            return ("return", self.expression())
        if word == "until":
            self.take()
            self.take("[")
            c = self.expression()
            self.take("]")
            return ("until", c, self.block())
        if word == "while":
            self.take()
            return ("while", self.expression(), self.block())
        if word == "for":
            self.take()
            name = self.take()
            self.take("in")
            a = self.sum_()
            self.take("..")
            return ("for", name, a, self.sum_(), self.block())
        name = self.take()
        if self.peek() == "[":
            self.take()
            mask = self.expression()
            self.take("]")
            self.take(":")
            return ("mask", name, mask, self.expression())
        op = self.take()
        if op not in (":", "+:", "-:"):
            raise SyntaxError(f"expected an assignment to {name}, found {op!r}")
        value = self.expression()
        return ("set", name, value if op == ":" else (op[0], ("name", name), value))

    def expression(self):
        c = self.or_()
        if self.peek() != "?":
            return c
        self.take()
        a = self.expression()
        self.take(":")
        return ("?", c, a, self.expression())

    def _left(self, below, ops):
        value = below()
        while self.peek() in ops:
            # name: or name+: or name[ ... ]: at the next token starts a new statement
            value = (self.take(), value, below())
        return value

    def or_(self):
        return self._left(self.and_, ("|",))

    def and_(self):
        return self._left(self.compare, ("&", "&~"))

    def compare(self):
        return self._left(self.sum_, ("<", ">", "<=", ">=", "==", "!="))

    def sum_(self):
        return self._left(self.product, ("+", "-"))

    def product(self):
        return self._left(self.prefix, ("*", "/"))

    def prefix(self):
        if self.peek() == "-":
            self.take()
            return ("-", ("num", 0), self.prefix())
        if self.peek() in WORDS and self.peek(1) not in (":", "+:", "-:"):
            word = self.take()
            if self.peek() == "(":
                return (word, *self.arguments())
            if word == "empty":
                return ("empty",)
            return (word, self.prefix())
        value = self.atom()
        while self.peek() == "@[":
            self.take()
            x = self.expression()
            self.take(";")
            how = self.take() if self.peek().startswith('"') else ""
            while self.peek() != "]":
                how += self.take()
            self.take("]")
            value = ("@", value, x, how)
        return value

    def arguments(self) -> list:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return out

    def atom(self):
        t = self.take()
        if t == "(":
            value = self.expression()
            self.take(")")
            return value
        if t[0] == '"':
            return ("str", t[1:-1])
        if t[0].isdigit():
            return ("num", float(t) if "." in t or "e" in t else int(t))
        if t in ("true", "false"):
            return ("num", t == "true")
        if self.peek() == "(":
            return ("call", t, self.arguments())
        return ("name", t)


class _Return(Exception):
    def __init__(self, value):
        self.value = value


class Script:
    """Functions of a text over one homogeneous relation of a graph (edges src, tgt) and its nodes."""

    def __init__(self, graph: PropertyGraph, relation: str, text: str, weight: str | None = None):
        self.graph, self.functions, self.weight = graph, _Parser(text).program(), weight
        r = graph.relation(relation)
        self.edges, self.nodes = staged(r.edges, "edges"), graph.nodes(r.source).select("id")

    def run(self, name: str, *arguments, max_rounds: int = 10_000):
        params, body = self.functions[name]
        scope, self.max_rounds = dict(zip(params, [self.graph, *arguments], strict=True)), max_rounds
        try:
            self._block(body, scope, False)
        except _Return as done:
            return done.value
        return None

    def _block(self, body: list, scope: dict, looped: bool) -> None:
        for s in body:
            if s[0] == "return":
                raise _Return(self._value(s[1], scope))
            if s[0] == "set":
                value = self._value(s[2], scope)
                scope[s[1]] = staged(value, "script") if looped and isinstance(value, DataFrame) else value
            elif s[0] == "mask":
                old, inside, value = scope[s[1]], self._value(s[2], scope).withColumn("_in", F.lit(True)), self._value(s[3], scope)
                both = old.join(inside, "id", "left")
                new = both.select("id", F.when(F.col("_in"), F.lit(float(value))).otherwise(F.col("val")).alias("val"))
                scope[s[1]] = staged(new, "script") if looped else new
            elif s[0] == "for":
                for k in range(int(self._value(s[2], scope)), int(self._value(s[3], scope))):
                    scope[s[1]] = k
                    self._block(s[4], scope, True)
            else:
                for k in range(self.max_rounds):
                    # an until loop may test what its first round defines
                    if s[0] == "while" and not self._true(s[1], scope) or s[0] == "until" and k and self._true(s[1], scope):
                        break
                    self._block(s[2], scope, True)
                else:
                    raise RuntimeError(f"more than {self.max_rounds} rounds")

    def _true(self, form, scope: dict) -> bool:
        value = self._value(form, scope)
        return not value.isEmpty() if isinstance(value, DataFrame) else bool(value)

    def _value(self, f, scope: dict):
        op = f[0]
        if op in ("num", "str"):
            return f[1]
        if op == "name":
            return self._named(f[1], scope)
        if op == "?":
            return self._value(f[2] if self._true(f[1], scope) else f[3], scope)
        if op == "call":
            params, body = self.functions[f[1]]
            try:
                self._block(body, dict(zip(params, [self._value(x, scope) for x in f[2]], strict=True)), False)
            except _Return as done:
                return done.value
            return None
        if op == "@":
            x, how = self._value(f[2], scope), f[3]
            if how.startswith('"'):
                return walk.walk(self.graph.edges(how.strip('"')), x)
            if how not in RINGS:
                raise SyntaxError(f"unknown semiring {how}")
            out = vectors.vxm(self.edges, x, RINGS[how], self.weight)
            return vectors.fill(out, self.nodes, INFINITY if how in ("min+", "minmin") else 0.0)
        args = [self._value(x, scope) for x in f[1:]]
        return self._word(op, args) if op in WORDS else self._binary(op, *args)

    def _named(self, name: str, scope: dict):
        if name in scope:
            return scope[name]
        head, _, part = name.partition(".")
        if part and scope.get(head) is self.graph:
            if part == "node_count":
                return self.nodes.count()
            if part == "nodes":
                return self.nodes
            if part in ("out_degrees", "in_degrees"):
                d = walk.degree(self.edges, self.nodes, "src" if part == "out_degrees" else "tgt")
                return d.select("id", F.col("degree").cast("double").alias("val"))
            if part == "triangles":
                from propgraph.sources.tables import simple_edges

                return structure.triangle_count(simple_edges(self.edges)).head()[0]
        if name == "INF":
            return INFINITY
        raise NameError(f"{name} is not defined")

    def _word(self, op: str, a: list):
        x = a[0] if a else None
        frame = isinstance(x, DataFrame)
        if op == "vector":
            return self.nodes.select("id", F.lit(float(a[1])).alias("val"))
        if op == "bitset":
            return x.select("id") if frame else sets.of(self.graph.spark, x if isinstance(x, (list, tuple)) else [x])
        if op == "empty":
            return self.nodes.limit(0) if x is None else x.isEmpty()
        if op == "not_empty":
            return not x.isEmpty()
        if op == "count":
            return x.count()
        if op == "sum":
            return x.agg(F.sum("val")).head()[0] or 0.0
        if op == "l2_norm":
            return vectors.l2_norm(x).head()[0]
        if op in ("min", "max") and len(a) == 2:
            return self._binary(op, *a)
        if op in ("min", "max"):
            return x.agg((F.min if op == "min" else F.max)("val")).head()[0]
        if op in ("abs", "sqrt"):
            return x.select("id", getattr(F, op)("val").alias("val")) if frame else abs(x) if op == "abs" else x**0.5
        raise NameError(f"{op} is not known here")

    @staticmethod
    def _binary(op: str, a, b):
        left, right = isinstance(a, DataFrame), isinstance(b, DataFrame)
        of = {
            "+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "<": lambda x, y: x < y, ">": lambda x, y: x > y,
            "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y,
        }
        if not left and not right:
            plain = of | {"/": lambda x, y: x / y, "|": lambda x, y: x or y, "&": lambda x, y: x and y, "&~": lambda x, y: x and not y, "min": min, "max": max}
            return plain[op](a, b)
        is_set = lambda d: isinstance(d, DataFrame) and "val" not in d.columns
        if is_set(a) and is_set(b):
            return {"|": sets.union, "&": sets.intersect, "&~": sets.difference}[op](a, b)
        of |= {"/": lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0)), "min": F.least, "max": F.greatest}
        if left and right:
            rows = a.select("id", F.col("val").alias("x")).join(b.select("id", F.col("val").alias("y")), "id")
            value = of[op](F.col("x"), F.col("y"))
        else:
            rows = a if left else b
            value = of[op](F.col("val"), F.lit(b)) if left else of[op](F.lit(a), F.col("val"))
        return rows.filter(value).select("id") if op in ("<", ">", "<=", ">=", "==", "!=") else rows.select("id", value.alias("val"))
