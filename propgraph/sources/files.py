"""Graph files: manifests with text or Parquet inputs, exports, tensor headers."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propgraph.model import PropertyGraph
from propgraph.plans.staging import staged

#: Manifest types; unknown ones are int32.
TYPES = {"int32": "int", "i32": "int", "uint32": "int", "u32": "int", "int64": "bigint", "i64": "bigint", "uint64": "bigint", "u64": "bigint", "float32": "float", "f32": "float", "float": "float", "float64": "double", "f64": "double", "double": "double", "string": "string", "str": "string", "utf8": "string"}


def is_parquet(path: str, kind: str | None) -> bool:
    return (kind or "").lower() in ("parquet", "pq") or path.lower().endswith((".parquet", ".pq"))


def read_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Lines of white-space separated fields; blank and ``#`` lines and those with too few fields are left out."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).filter("line <> '' and not startswith(line, '#')")
    parts = F.split("line", " ")
    return lines.filter(F.size(parts) >= min(2, len(columns))).select(*[F.get(parts, i).alias(c) for i, c in enumerate(columns)])


def read_columns(spark: SparkSession, path: str, kind: str | None, columns: list[str]) -> DataFrame:
    """Columns of a Parquet, CSV, JSON-lines or text file as strings; only they are read. Missing ones are null."""
    if is_parquet(path, kind):
        df = spark.read.parquet(path)
    elif (kind or "").lower() == "csv" or path.lower().endswith(".csv"):
        df = spark.read.csv(path, header=True)
    elif (kind or "").lower() in ("json", "jsonl") or path.lower().endswith((".json", ".jsonl")):
        df = spark.read.json(path)
    else:
        return read_text(spark, path, columns)
    return df.select(*[(df[c].cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def typed(column: str, kind: str | None) -> Column:
    """A string as the manifest's type; what does not parse is 0."""
    sql = TYPES.get((kind or "int32").lower(), "int")
    return F.col(column) if sql == "string" else F.coalesce(F.expr(f"try_cast(`{column}` AS {sql})"), F.lit(0).cast(sql))


def dense_ids(keys: DataFrame) -> DataFrame:
    """(key, id) from (key, file, row): ids count up by first appearance.

    Keys are sorted by range partitions and numbered with the sizes of the partitions before, so
    no task sees all of them.
    """
    first = keys.groupBy("key").agg(F.min(F.struct("file", "row")).alias("at"))
    ordered = staged(first.repartitionByRange("at").sortWithinPartitions("at").withColumn("m", F.monotonically_increasing_id()), "keys")
    part = F.shiftrightunsigned("m", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    offset, before = {}, 0
    for p in sorted(sizes):
        offset[p], before = before, before + sizes[p]
    starts = keys.sparkSession.createDataFrame(list(offset.items()) or [(0, 0)], "p long, start long")
    return ordered.withColumn("p", part).join(F.broadcast(starts), "p").select("key", (F.col("start") + F.expr("m & 8589934591")).alias("id"))


def from_manifest(spark: SparkSession, manifest: str | dict, folder: str = "") -> PropertyGraph:
    """Builds a graph from a manifest (dict, JSON text or path): domains and relations with their files.

    Keys get dense ids by first appearance: domain files first, then relations in order, source
    before target. Null keys are dropped. Parallel edges and loops stay. Relations are named by their
    file's stem unless they have a name; the same (src_domain, tgt_domain, file) twice is an error.
    """
    if isinstance(manifest, str):
        text = manifest if manifest.lstrip().startswith("{") else "\n".join(r.value for r in spark.read.text(manifest).collect())
        manifest = json.loads(text)
    place = lambda f: f if "/" in f and (f.startswith("/") or "://" in f) else f"{folder}/{f}" if folder else f
    domains, relations = {d["id"]: d for d in manifest.get("domains", [])}, manifest.get("relations", [])
    seen = set()
    for r in relations:
        mark = (r["src_domain"], r["tgt_domain"], r["file"])
        if mark in seen:
            raise ValueError(f"Duplicate relation definition: {mark}")
        seen.add(mark)
        for end in ("src_domain", "tgt_domain"):
            if r[end] not in domains:
                raise ValueError(f"relation {r.get('name', r['file'])} names the undeclared domain {r[end]}")
    keys: dict[int, list[DataFrame]] = {i: [] for i in domains}
    extras: dict[int, DataFrame] = {}
    numbered = lambda df: df.withColumn("row", F.monotonically_increasing_id())
    for k, (i, d) in enumerate(domains.items()):
        if d.get("file"):
            column = d.get("id_column", "id")
            wanted = [column] + [a["column"] for a in d.get("attributes", [])]
            df = staged(numbered(read_columns(spark, place(d["file"]), d.get("format"), wanted)).withColumnRenamed(column, "key").filter("key is not null"), "domain")
            keys[i].append(df.select("key", F.lit(k).alias("file"), (F.col("row") * 2).alias("row")))
            if d.get("attributes"):
                extras[i] = df.dropDuplicates(["key"]).select("key", *[typed(a["column"], a.get("type")).alias(a["name"]) for a in d["attributes"]])
    raw = []
    for k, r in enumerate(relations):
        src, tgt = r.get("src_column", "src"), r.get("tgt_column", "tgt")
        wanted = [src, tgt] + [a["column"] for a in r.get("attributes", [])]
        df = staged(numbered(read_columns(spark, place(r["file"]), r.get("format"), wanted)).filter(F.col(src).isNotNull() & F.col(tgt).isNotNull()), "relation")
        raw.append((r, df, src, tgt))
        file = len(domains) + k
        keys[r["src_domain"]].append(df.select(F.col(src).alias("key"), F.lit(file).alias("file"), (F.col("row") * 2).alias("row")))
        keys[r["tgt_domain"]].append(df.select(F.col(tgt).alias("key"), F.lit(file).alias("file"), (F.col("row") * 2 + 1).alias("row")))
    graph, ids = PropertyGraph(spark), {}
    for i, d in domains.items():
        every = keys[i][0] if keys[i] else spark.createDataFrame([], "key string, file int, row long")
        for more in keys[i][1:]:
            every = every.unionByName(more)
        ids[i] = staged(dense_ids(every), "ids")
        nodes = ids[i].select("id", "key")
        graph.add_domain(d["name"], nodes.join(extras[i], "key", "left") if i in extras else nodes, d.get("key_type", "int32"))
    for r, df, src, tgt in raw:
        name = r.get("name") or r["file"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
        a, b = ids[r["src_domain"]], ids[r["tgt_domain"]]
        edges = df.join(a.select(F.col("key").alias(src), F.col("id").alias("_s")), src).join(b.select(F.col("key").alias(tgt), F.col("id").alias("_t")), tgt)
        edges = edges.select(F.col("_s").alias("src"), F.col("_t").alias("tgt"), *[typed(x["column"], x.get("type")).alias(x["name"]) for x in r.get("attributes", [])])
        graph.add_relation(name, domains[r["src_domain"]]["name"], domains[r["tgt_domain"]]["name"], edges)
    return graph


def export_edges(graph: PropertyGraph, folder: str, kind: str = "tsv") -> list[str]:
    """A folder per relation: tsv and csv without header, jsonl; ids, sorted by (src, tgt)."""
    out = []
    for r in graph.relations.values():
        path = f"{folder}/{r.name}.{kind}"
        rows = r.edges.select("src", "tgt").repartitionByRange("src", "tgt").sortWithinPartitions("src", "tgt").write.mode("overwrite")
        if kind not in ("tsv", "csv", "jsonl"):
            raise ValueError(f"unknown format {kind}")
        rows.json(path) if kind == "jsonl" else rows.csv(path, sep="\t" if kind == "tsv" else ",")
        out.append(path)
    return out


def write_delimited(edges: DataFrame, path: str, kind: str = "tsv") -> None:
    """With a header; float with four decimals, double with six."""
    shown = [F.format_string("%.4f", c).alias(c) if t == "float" else F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in edges.dtypes]
    edges.select(*shown).write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",")


def tensor_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, dtype, shape, nbytes) of the tensors in safetensors files, from their headers."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                (size,) = struct.unpack("<Q", content[:8])
                for name, about in json.loads(content[8 : 8 + size]).items():
                    if name != "__metadata__":
                        a, b = about["data_offsets"]
                        rows.append((file, name, about["dtype"], about["shape"], b - a))
            yield pd.DataFrame(rows, columns=["file", "name", "dtype", "shape", "nbytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, name string, dtype string, shape array<long>, nbytes long")


def tensor_domain(spark: SparkSession, path: str, name: str) -> PropertyGraph:
    """A graph with a node for each tensor, in the order of files and names, and no relation."""
    rows = tensor_headers(spark, path).select(F.concat_ws("/", F.element_at(F.split("file", "/"), -1), "name").alias("key"), "dtype", "shape", "nbytes", F.col("file"))
    ids = dense_ids(rows.select("key", F.lit(0).alias("file"), F.row_number().over(Window.orderBy("file", "key")).alias("row")))  # a row per tensor of a model
    return PropertyGraph(spark).add_domain(name, rows.drop("file").join(ids, "key"), "string")
