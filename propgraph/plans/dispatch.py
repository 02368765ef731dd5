"""Programs in any of the graph languages, told apart by name or by file ending."""

from __future__ import annotations

from pathlib import PurePath

from propgraph.model import PropertyGraph
from propgraph.plans import cypher, datalog, program, sexpr

#: File endings of each language.
ENDINGS = {".dl": "datalog", ".datalog": "datalog", ".cypher": "cypher", ".cql": "cypher", ".scm": "sexpr", ".asm": "program", ".vec": "script"}


def language_of(file: str) -> str:
    ending = PurePath(file).suffix.lower()
    if ending not in ENDINGS:
        raise ValueError(f"no language has the ending {ending!r}; there are {sorted(ENDINGS)}")
    return ENDINGS[ending]


def compiled(text: str, language: str):
    """The parsed form of a program, or an error that says what is wrong with it."""
    from propgraph.plans import script

    if language == "datalog":
        declared, rules = datalog.parse(text)
        for rule in rules:
            datalog.check_safe(rule)
        return declared, datalog.stratify(rules), rules
    readers = {"sexpr": sexpr.parse, "program": program.assemble, "script": lambda t: script._Parser(t).program()}
    if language in readers:
        return readers[language](text)
    if language == "cypher":
        return text.strip()
    raise ValueError(f"unknown language {language}")


def query(graph: PropertyGraph, text: str, language: str, **arguments):
    """Runs a program on a graph. Datalog takes its relations as (src, tgt) facts under their names and wants ``goal``;
    a script wants ``function``, ``relation`` and ``args``; a program takes ``start``; S-expressions take their parameters."""
    if language == "datalog":
        facts = {name: r.edges.select("src", "tgt") for name, r in graph.relations.items()}
        return datalog.run(graph.spark, text, facts, arguments["goal"])
    if language == "cypher":
        return cypher.run(graph, text)
    if language == "sexpr":
        return sexpr.run(graph, text, **arguments)
    if language == "program":
        return program.Machine(graph).run(text, arguments.get("start", 0))
    if language == "script":
        from propgraph.plans.script import Script

        return Script(graph, arguments["relation"], text).run(arguments["function"], *arguments.get("args", []))
    raise ValueError(f"unknown language {language}")
