"""Command line: python -m propgraph <command>. Graphs are folders written by ``build``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from propgraph.functions import signatures, statistics
from propgraph.model import PropertyGraph
from propgraph.operators import maintenance
from propgraph.plans import dispatch, program, records
from propgraph.sources import files, generate


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="propgraph")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *arguments: str, **options: str) -> argparse.ArgumentParser:
        command = commands.add_parser(name)
        for a in arguments:
            command.add_argument(a)
        for option, default in options.items():
            command.add_argument(f"--{option}", default=default)
        return command

    add("build", "manifest", "graph", base="")
    add("inspect", "graph").add_argument("--json", action="store_true")
    add("stats", "graph", "relation", attribute="")
    add("validate", "graph")
    add("diff", "base", "target")
    add("export", "graph", "folder", format="tsv")
    add("generate", "profile", "folder", options="{}", attributes="", format="tsv")
    add("run", "graph", "file", arguments="{}", limit="20")
    add("compile", "file")
    add("assemble", "file", "out")
    add("disassemble", "file")
    add("digest", "table")
    add("keygen", "prefix")
    add("sign", "graph", "key")
    add("verify", "graph", "key")
    return top


def _show(df: DataFrame, limit: int = 1000) -> None:
    for row in df.limit(limit).collect():
        print(json.dumps(row.asDict(recursive=True), default=str))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if validation finds something or graphs differ."""
    a = _parser().parse_args(argv)
    if a.command == "compile":
        print(dispatch.compiled(open(a.file).read(), dispatch.language_of(a.file)))
        return 0
    if a.command == "assemble":
        made = records.encode(program.assemble(open(a.file).read()))
        with open(a.out, "wb") as out:
            out.write(made.code)
        with open(f"{a.out}.json", "w") as out:
            json.dump({"constants": made.constants, "names": made.names}, out)
        return 0
    if a.command == "disassemble":
        with open(a.file, "rb") as code, open(f"{a.file}.json") as beside:
            print(program.disassemble(records.decode(records.Records(code.read(), **json.load(beside)))))
        return 0
    if a.command == "keygen":
        signatures.write_keys(a.prefix)
        return 0
    spark = spark or SparkSession.builder.appName("propgraph").getOrCreate()
    if a.command == "build":
        text = "\n".join(r.value for r in spark.read.text(a.manifest, wholetext=True).collect())
        files.from_manifest(spark, text, a.base or a.manifest.rpartition("/")[0]).save(a.graph)
    elif a.command == "inspect":
        g = PropertyGraph.load(spark, a.graph)
        if a.json:
            print(json.dumps({"domains": [r.asDict() for r in g.describe_domains().collect()], "relations": [r.asDict() for r in g.describe_relations().collect()]}))
        else:
            g.describe_domains().show(1000, False)
            g.describe_relations().show(1000, False)
    elif a.command == "stats":
        r = PropertyGraph.load(spark, a.graph)
        edges, relation = r.edges(a.relation), r.relation(a.relation)
        _show(statistics.topology(edges, r.nodes(relation.source), r.nodes(relation.target)))
        _show(statistics.degrees(edges, r.nodes(relation.source)))
        _show(statistics.multiplicity(edges))
        if a.attribute:
            print(statistics.zone_map_text(edges, a.attribute))
    elif a.command == "validate":
        found = maintenance.validate_saved(spark, a.graph)
        _show(found)
        return int(not found.filter("not startswith(`check`, 'warning')").isEmpty())
    elif a.command == "diff":
        found = maintenance.diff_counts(PropertyGraph.load(spark, a.base), PropertyGraph.load(spark, a.target))
        _show(found)
        return int(not found.filter("delta <> 0").isEmpty())
    elif a.command == "export":
        print("\n".join(files.export_edges(PropertyGraph.load(spark, a.graph), a.folder, a.format)))
    elif a.command == "generate":
        edges = generate.generate(spark, a.profile, **json.loads(a.options))
        files.write_delimited(generate.with_attributes(edges, a.attributes) if a.attributes else edges, a.folder, a.format)
    elif a.command == "run":
        out = dispatch.query(PropertyGraph.load(spark, a.graph), open(a.file).read(), dispatch.language_of(a.file), **json.loads(a.arguments))
        if isinstance(out, DataFrame):
            _show(out, int(a.limit))
        else:
            print(json.dumps(out, default=str))
    elif a.command == "sign":
        signatures.sign_graph(spark, a.graph, bytes.fromhex(open(a.key).read().strip()))
    elif a.command == "verify":
        good = signatures.verify_graph(spark, a.graph, bytes.fromhex(open(a.key).read().strip()))
        print("valid" if good else "not valid")
        return int(not good)
    elif a.command == "digest":
        _show(maintenance.content_digest(spark.read.parquet(a.table)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
