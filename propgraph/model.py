"""Property graphs: node domains and named edge relations, each a DataFrame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.plans.staging import new_path


@dataclass
class Domain:
    """Nodes of one type: ``nodes`` has id BIGINT, key and attributes."""

    name: str
    nodes: DataFrame
    key_type: str = "int64"


@dataclass
class Relation:
    """Directed edges between two domains: ``edges`` has src, tgt and attributes. Parallel edges and loops stay."""

    name: str
    source: str
    target: str
    edges: DataFrame


@dataclass
class PropertyGraph:
    """Domains and relations by name; names are looked up without regard to case."""

    spark: SparkSession
    domains: dict[str, Domain] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)

    def add_domain(self, name: str, nodes: DataFrame, key_type: str = "int64") -> PropertyGraph:
        if "key" not in nodes.columns:
            nodes = nodes.withColumn("key", F.col("id").cast("string"))
        self.domains[name] = Domain(name, nodes, key_type)
        return self

    def add_relation(self, name: str, source: str, target: str, edges: DataFrame) -> PropertyGraph:
        for domain in (source, target):
            if domain not in self.domains:
                raise ValueError(f"relation {name} names the undeclared domain {domain}")
        self.relations[name] = Relation(name, source, target, edges)
        return self

    def relation(self, name: str) -> Relation:
        found = [r for n, r in self.relations.items() if n.lower() == name.lower()]
        if not found:
            raise KeyError(f"no relation {name}; there are {sorted(self.relations)}")
        return found[0]

    def domain(self, name: str) -> Domain:
        found = [d for n, d in self.domains.items() if n.lower() == name.lower()]
        if not found:
            raise KeyError(f"no domain {name}; there are {sorted(self.domains)}")
        return found[0]

    def edges(self, name: str) -> DataFrame:
        return self.relation(name).edges

    def nodes(self, name: str) -> DataFrame:
        return self.domain(name).nodes

    def save(self, path: str) -> None:
        """Parquet folders and a catalog; edges are clustered by source, so walks prune row groups."""
        for d in self.domains.values():
            d.nodes.write.mode("overwrite").parquet(f"{path}/domains/{d.name}")
        for r in self.relations.values():
            order = [c for c in ("src", "tgt") if c in r.edges.columns]
            r.edges.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/relations/{r.name}")
        about = {
            "format": 1,
            "domains": [{"name": d.name, "key_type": d.key_type} for d in self.domains.values()],
            "relations": [{
                "name": r.name, "src_domain": r.source, "tgt_domain": r.target, "edge_count": self.spark.read.parquet(f"{path}/relations/{r.name}").count(),
                "attributes": [c for c in r.edges.columns if c not in ("src", "tgt")],
            } for r in self.relations.values()],
        }
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        about = json.loads(spark.read.text(f"{path}/catalog").head().value)
        if about.get("format") != 1:
            raise ValueError(f"unknown catalog format {about.get('format')}")
        graph = PropertyGraph(spark)
        for d in about["domains"]:
            graph.add_domain(d["name"], spark.read.parquet(f"{path}/domains/{d['name']}"), d["key_type"])
        for r in about["relations"]:
            graph.add_relation(r["name"], r["src_domain"], r["tgt_domain"], spark.read.parquet(f"{path}/relations/{r['name']}"))
        return graph

    def saved(self) -> PropertyGraph:
        """The graph written to the shared folder and read back."""
        path = new_path(self.spark, "graph")
        self.save(path)
        return PropertyGraph.load(self.spark, path)

    def describe_domains(self) -> DataFrame:
        """One row per domain: name, key_type, node_count."""
        parts = [d.nodes.agg(F.count(F.lit(1)).alias("node_count")).select(F.lit(d.name).alias("domain"), F.lit(d.key_type).alias("key_type"), "node_count") for d in self.domains.values()]
        return _union(parts)

    def describe_relations(self) -> DataFrame:
        """One row per relation: domains, node_count of the source side, edge_count, attributes, average degree."""
        parts = []
        for r in self.relations.values():
            names = sorted(c for c in r.edges.columns if c not in ("src", "tgt"))
            nodes = self.domains[r.source].nodes.agg(F.count(F.lit(1)).alias("node_count"))
            edges = r.edges.agg(F.count(F.lit(1)).alias("edge_count"))
            parts.append(nodes.crossJoin(edges).select(  # one row each
                F.lit(r.name).alias("relation"), F.lit(r.source).alias("src_domain"), F.lit(r.target).alias("tgt_domain"), "node_count", "edge_count",
                F.lit(",".join(names)).alias("attributes"), F.when(F.col("node_count") > 0, F.col("edge_count") / F.col("node_count")).otherwise(0.0).alias("avg_degree"),
            ))
        return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
