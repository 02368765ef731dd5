"""Path patterns: MATCH (a:Domain {attr: value})-[r:RELATION]->(b)<-[:R]-(c) WHERE ... RETURN [DISTINCT] ... LIMIT n.

A pattern is a chain of equi-joins. Each variable is a struct of its node's or edge's columns, so
conditions and results are Spark SQL over ``a.key``, ``r.weight`` and so on, and reach the scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.model import PropertyGraph

_NODE = r"\(\s*(?P<var>\w*)\s*(?::\s*(?P<label>\w+))?\s*(?:\{(?P<props>[^}]*)\})?\s*\)"
_EDGE = r"(?P<left><)?-\s*\[\s*(?P<var>\w*)\s*(?::\s*(?P<label>\w+))?\s*\]\s*-(?P<right>>)?"
_QUERY = re.compile(r"\s*MATCH\s+(?P<path>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<what>.+?)(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$", re.I | re.S)


def _node(graph: PropertyGraph, label: str, name: str, props: str | None) -> DataFrame:
    df = graph.nodes(label)
    for item in (props or "").split(","):
        if item.strip():
            key, _, value = item.partition(":")
            df = df.filter(F.col(key.strip()) == F.expr(value.strip()))
    return df.select(F.struct(*df.columns).alias(name))


def run(graph: PropertyGraph, text: str) -> DataFrame:
    """The result of a query; a returned variable is its key (nodes) or its struct (edges)."""
    m = _QUERY.match(text)
    if not m:
        raise SyntaxError("expected MATCH ... RETURN ...")
    path, at, fresh = m["path"].strip(), 0, 0
    labels: dict[str, str] = {}
    parts = []
    while at < len(path):
        found = re.compile(r"\s*" + (_EDGE if len(parts) % 2 else _NODE) + r"\s*").match(path, at)
        if not found:
            raise SyntaxError(f"cannot read the pattern at {path[at:at + 20]!r}")
        parts.append(found.groupdict())
        at = found.end()
    if len(parts) % 2 == 0:
        raise SyntaxError("a pattern ends with a node")
    for p in parts:
        if not p["var"]:
            fresh += 1
            p["var"] = f"_{fresh}"
    for k in range(1, len(parts), 2):
        e = parts[k]
        if not e["label"] or bool(e["left"]) == bool(e["right"]):
            raise SyntaxError("an edge needs a relation and one direction")
        r = graph.relation(e["label"])
        for node, domain in ((parts[k - 1], r.target if e["left"] else r.source), (parts[k + 1], r.source if e["left"] else r.target)):
            node["label"] = node["label"] or domain
            if node["label"].lower() != domain.lower():
                raise ValueError(f"{e['label']} does not join {node['label']}")
    if not parts[0]["label"]:
        raise SyntaxError("a single node needs a label")
    first = parts[0]
    labels[first["var"]] = first["label"]
    rows = _node(graph, first["label"], first["var"], first["props"])
    for k in range(1, len(parts), 2):
        e, last, node = parts[k], parts[k - 1]["var"], parts[k + 1]
        edges = graph.edges(e["label"])
        edges = edges.select(F.struct(*edges.columns).alias(e["var"]))
        near, far = ("tgt", "src") if e["left"] else ("src", "tgt")
        rows = rows.join(edges, F.col(f"{last}.id") == F.col(f"{e['var']}.{near}"))
        if node["var"] in labels:  # the path comes back to a node
            rows = rows.filter(F.col(f"{e['var']}.{far}") == F.col(f"{node['var']}.id"))
            continue
        labels[node["var"]] = node["label"]
        rows = rows.join(_node(graph, node["label"], node["var"], node["props"]), F.col(f"{e['var']}.{far}") == F.col(f"{node['var']}.id"))
    if m["where"]:
        rows = rows.filter(F.expr(m["where"]))
    out = []
    for item in re.split(r",(?![^()]*\))", m["what"]):
        expression, _, name = re.sub(r"\s+AS\s+", " AS ", item.strip(), flags=re.I).partition(" AS ")
        plain = expression.strip()
        out.append(F.expr(f"{plain}.key" if plain in labels else plain).alias(name.strip() or plain.replace(".", "_")))
    rows = rows.select(*out) if not re.search(r"\b(count|sum|min|max|avg)\s*\(", m["what"], re.I) else rows.agg(*out)
    rows = rows.distinct() if m["distinct"] else rows
    return rows.limit(int(m["limit"])) if m["limit"] else rows
