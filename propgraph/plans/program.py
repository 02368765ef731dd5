"""Register programs in assembly text: directives, labels and one instruction a line, on 64 registers.

Registers hold node sets (id), vectors (id, val), numbers or strings. R0 holds the input, R63 the
result. ``; text`` is a comment, ``name:`` a label, an address before an instruction is ignored. After
the operands, ``ACCUMULATE`` combines with what the target register holds and ``INVERT`` takes the
complement in the nodes of the relation's target domain.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.model import PropertyGraph
from propgraph.operators import ranking, sampling, sets, structure, traversal, vectors, walk
from propgraph.operators.components import connected_components

PROBES = {"HAS_CSR", "HAS_CSC", "HAS_COO", "HAS_DENSE", "HAS_KEY_CATALOG"}
IGNORED = {"NOP", "CREATE_SCRATCH_INDEX", "DROP_SCRATCH_INDEX", "ALLOC_SCRATCH", "ASSERT_SCRATCH_BYTES", "SET_MAX_DOP"}
FLAGS = {"BITSET", "ACCUMULATE", "INVERT", "OFFHEAP"}
CALL_DEPTH = 8


@dataclass
class Instruction:
    op: str
    args: list[str]
    flags: set[str] = field(default_factory=set)


@dataclass
class Program:
    instructions: list[Instruction]
    labels: dict[str, int]
    names: dict[str, str]


def assemble(text: str) -> Program:
    """Reads a text; directives ``.relation "name" = 0`` name what REL_0 stands for."""
    out, labels, names = [], {}, {}
    for raw in text.splitlines():
        line = re.sub(r'((?:[^";]|"[^"]*")*).*', r"\1", raw).strip()  # a semicolon outside quotes begins a comment
        if not line:
            continue
        if m := re.fullmatch(r'\.(domain|relation|attribute)\s+"([^"]+)"\s*=\s*(\d+)', line):
            names[{"domain": "DOMAIN_", "relation": "REL_", "attribute": "ATTR_"}[m[1]] + m[3]] = m[2]
            continue
        line = re.sub(r"^0x[0-9a-fA-F]+:\s*", "", line)
        while m := re.match(r"([A-Za-z_]\w*):\s*", line):
            labels[m[1]] = len(out)
            line = line[m.end() :]
        if line:
            op, _, rest = line.partition(" ")
            args = [a.strip() for a in re.findall(r'(?:[^",]|"[^"]*")+', rest) if a.strip()]
            if args and all(re.match(r"(?i)(dst|payload|flags)\s*=", a) for a in args):
                args = _from_named(args)
            flags = {a for a in args if a.upper() in FLAGS}
            out.append(Instruction(op.upper().removeprefix("OP_"), [a for a in args if a not in flags], {f.upper() for f in flags}))
    return Program(out, labels, names)


def _from_named(args: list[str]) -> list[str]:
    """Operands in order, from ``dst=R1, payload=R0 | REL_0, flags=INVERT``."""
    given = {k.strip().lower(): [w.strip() for w in v.split("|")] for k, _, v in (a.partition("=") for a in args)}
    flags = [f.upper().removeprefix("FLAG_").removeprefix("MODE_") for f in given.get("flags", [])]
    return [*given.get("dst", []), *given.get("payload", []), *(f for f in flags if f in FLAGS)]


def disassemble(program: Program) -> str:
    """The text of a program, with labels where they point."""
    at = {v: k for k, v in program.labels.items()}
    kinds = {"DOMAIN_": "domain", "REL_": "relation", "ATTR_": "attribute"}
    lines = [f'.{kinds[k.rstrip("0123456789")]} "{v}" = {k.lstrip("DOMAINRELT_")}' for k, v in program.names.items()]
    for k, i in enumerate(program.instructions):
        lines.append((f"{at[k]}: " if k in at else "") + f"OP_{i.op} " + ", ".join([*i.args, *sorted(i.flags)]))
    return "\n".join(lines) + "".join(f"\n{name}:" for k, name in at.items() if k >= len(program.instructions))


class Machine:
    def __init__(self, graph: PropertyGraph, max_steps: int = 100_000):
        self.graph, self.max_steps = graph, max_steps
        self.registers: dict[int, object] = {}
        self.frames: list[dict[int, object]] = []

    # operands
    def _register(self, name: str) -> int:
        m = re.fullmatch(r"R(\d+)", name)
        if not m or int(m[1]) > 63:
            raise ValueError(f"{name} is not a register")
        return int(m[1])

    def _get(self, name: str):
        if re.fullmatch(r"R\d+", name):
            if self._register(name) not in self.registers:
                raise ValueError(f"{name} holds nothing")
            return self.registers[self._register(name)]
        return self._literal(name)

    @staticmethod
    def _literal(text: str):
        if text.startswith('"'):
            return text.strip('"')
        return int(text, 0) if re.fullmatch(r"-?(0x[0-9a-fA-F]+|\d+)", text) else float(text)

    def _relation(self, name: str):
        return self.graph.relation(self.program.names.get(name, name))

    def _set(self, name: str) -> DataFrame:
        value = self._get(name)
        return value.select("id") if isinstance(value, DataFrame) else sets.of(self.graph.spark, value if isinstance(value, list) else [value])

    def _vector(self, name: str) -> DataFrame:
        value = self._get(name)
        return value if "val" in value.columns else value.withColumn("val", F.lit(1.0))

    def run(self, text: str | Program, start=0):
        """Runs to HALT or the end; the value of R63."""
        self.program = text if isinstance(text, Program) else assemble(text)
        self.registers[0] = start
        code, at, calls = self.program.instructions, 0, []
        for _ in range(self.max_steps):
            if at >= len(code) or code[at].op == "HALT":
                return self.registers.get(63)
            i = code[at]
            at += 1
            to = lambda name: self.program.labels[name] if name in self.program.labels else at - 1 + int(name, 0)  # noqa: B023, E731
            if i.op == "JMP":
                at = to(i.args[0])
            elif i.op in ("JZ", "JNZ"):
                if self._zero(i.args[0]) == (i.op == "JZ"):
                    at = to(i.args[1])
            elif i.op == "LOOP_DECR":
                k = self._register(i.args[0])
                self.registers[k] -= 1
                if self.registers[k] > 0:
                    at = to(i.args[1])
            elif i.op == "CALL":
                if len(calls) == CALL_DEPTH:
                    raise RecursionError(f"more than {CALL_DEPTH} calls")
                calls.append(at)
                at = to(i.args[0])
            elif i.op == "RET":
                if not calls:
                    return self.registers.get(63)
                at = calls.pop()
            elif i.op in ("THROW", "TRAP"):
                raise RuntimeError(f"{i.op} {' '.join(i.args)}")
            elif i.op == "ASSERT":
                if self._zero(i.args[0]):
                    raise AssertionError(" ".join(i.args))
            elif i.op == "ENTER_FRAME":
                self.frames.append(dict(self.registers))
            elif i.op == "LEAVE_FRAME":  # R0 and R63, the input and the result, stay as they are
                if not self.frames:
                    raise RuntimeError("LEAVE_FRAME without ENTER_FRAME")
                now = {k: v for k, v in self.registers.items() if k in (0, 63)}
                self.registers = {k: v for k, v in self.frames.pop().items() if k not in (0, 63)} | now
            elif i.op not in IGNORED:
                self._step(i)
        raise RuntimeError(f"more than {self.max_steps} steps")

    def _has(self, op: str, a: list[str]) -> int:
        """1 if the relation (or any, if none is named) can be walked so, or the domain has keys of its own; no relation is dense."""
        names = [self.program.names.get(x, x).lower() for x in a]
        if op == "HAS_KEY_CATALOG":
            found = [d for d in self.graph.domains.values() if (not names or d.name.lower() in names) and d.key_type != "int64"]
        else:
            found = [r for r in self.graph.relations.values() if op != "HAS_DENSE" and (not names or r.name.lower() in names)]
        return int(bool(found))

    def _zero(self, name: str) -> bool:
        value = self._get(name)
        return value.isEmpty() if isinstance(value, DataFrame) else not value

    def _step(self, i: Instruction) -> None:
        k, a = self._register(i.args[0]), i.args[1:]
        value = self._result(i.op, a)
        if "INVERT" in i.flags:
            relation = next((self._relation(x) for x in a if x in self.program.names), None)
            domain = relation.target if relation else next(iter(self.graph.domains))
            value = sets.complement(value, self.graph.nodes(domain))
        if "ACCUMULATE" in i.flags and k in self.registers:
            old = self.registers[k]
            value = vectors.ewise_add(old, value) if "val" in getattr(value, "columns", []) else sets.union(old, value) if isinstance(value, DataFrame) else old + value
        self.registers[k] = value

    def _result(self, op: str, a: list[str]):
        g = self.graph
        if op in PROBES:
            return self._has(op, a)
        if op in ("INIT_INPUT_NODE", "INIT_INPUT_SET", "LOAD_INLINE_ARRAY"):
            return sets.of(g.spark, [self._get(x) for x in a]) if len(a) > 1 else self._set(a[0] if a and a[0] != "0" or not a else "R0")
        if op in ("LOAD_CONST_INT", "LOAD_CONST_FLOAT", "LOAD_CONST_STR_PREFIX"):
            return self._literal(a[0])
        if op in ("MOV", "MOVE", "COLLECT_BITSET"):
            return self._get(a[0])
        if op == "LOAD_INDIRECT":  # the register whose number the operand holds
            return self._get(f"R{int(self._get(a[0]))}")
        if op == "CLEAR_REG":
            return 0
        if op in ("CSR_WALK", "DENSE_WALK"):
            return walk.walk(self._relation(a[1]).edges, self._set(a[0]))
        if op == "CSR_WALK_2HOP":
            return walk.walk_two(self._relation(a[1]).edges, self._set(a[0]))
        if op == "CSR_WALK_FILTERED":
            return walk.walk_filtered(self._relation(a[2]).edges, self._set(a[0]), self._set(a[1]))
        if op == "CSR_WALK_PREDICATE":
            return walk.walk_where(self._relation(a[1]).edges, self._set(a[0]), self._get(a[2]))
        if op in ("CSR_WALK_REDUCE_SUM", "CSR_WALK_REDUCE"):
            return walk.walk_reduce(self._relation(a[1]).edges, self._vector(a[0]), a[2].lower() if len(a) > 2 else "add")
        if op == "CSR_DEGREE":
            r = self._relation(a[-1])
            return walk.degree(r.edges, g.nodes(r.source)).withColumnRenamed("degree", "val")
        if op == "CSC_WALK":
            return walk.walk_back(self._relation(a[-1]).edges, self._set(a[0]), self._set(a[1]) if len(a) > 2 else None)
        if op == "NODE_FILTER":
            return walk.node_filter(self._set(a[0]), g.nodes(self.program.names.get(a[1], a[1])), self._get(a[2]))
        if op == "NODE_FILTER_STR_PREFIX":
            return walk.node_filter_prefix(self._set(a[0]), g.nodes(self.program.names.get(a[1], a[1])), str(self._get(a[2])))
        if op in ("SET_UNION", "ROARING_BITMAP_OR"):
            return sets.union(self._set(a[0]), self._set(a[1]))
        if op in ("SET_INTERSECT", "ROARING_BITMAP_AND"):
            return sets.intersect(self._set(a[0]), self._set(a[1]))
        if op in ("SET_DIFFERENCE", "ROARING_BITMAP_AND_NOT"):
            return sets.difference(self._set(a[0]), self._set(a[1]))
        if op == "SET_CARDINALITY":
            return self._set(a[0]).distinct().count()
        if op == "STABLE_CHECK":
            one, other = self._set(a[0]), self._set(a[1])
            return int(sets.difference(one, other).isEmpty() and sets.difference(other, one).isEmpty())
        if op in ("MXV", "VXM", "SPARSE_MATVEC"):
            ring = (a[2] if len(a) > 2 else "PLUS_TIMES").removeprefix("SEMIRING_").lower()
            return (vectors.mxv if op == "MXV" else vectors.vxm)(self._relation(a[1]).edges, self._vector(a[0]), ring)
        if op in ("EWISE_ADD", "EWISE_MULT"):
            how = (a[2] if len(a) > 2 else "ADD" if op == "EWISE_ADD" else "MUL").upper().removeprefix("BINARY_OP_").lower()
            return (vectors.ewise_add if op == "EWISE_ADD" else vectors.ewise_mult)(self._vector(a[0]), self._vector(a[1]), how)
        if op in ("REDUCE", "VECTOR_REDUCE_SUM"):
            return vectors.reduce(self._vector(a[0]), a[1].lower() if len(a) > 1 else "add").head()[0]
        if op == "VECTOR_DIV":
            return vectors.divide(self._vector(a[0]), self._vector(a[1]))
        if op == "VECTOR_MUL_ATTR":
            return vectors.times_attribute(self._vector(a[0]), g.nodes(self.program.names.get(a[1], a[1])), self.program.names.get(a[2], a[2]))
        if op == "VECTOR_STR_CONCAT":
            return vectors.concat(self._vector(a[0]), self._vector(a[1]))
        if op == "FLOAT_VECTOR_SCALE":
            return vectors.scale(self._vector(a[0]), float(self._get(a[1])))
        if op == "L1_NORM_DIFF":
            return vectors.l1_distance(self._vector(a[0]), self._vector(a[1])).head()[0]
        if op in ("CC_AFFOREST", "CC_HOOK_COMPRESS"):
            return connected_components(self._relation(a[-1]).edges.select("src", F.col("tgt").alias("dst"))).withColumnRenamed("component", "val")
        if op == "ISLAND_DETECT":
            return structure.islands(self._relation(a[-1]).edges, self._set(a[0])).withColumnRenamed("component", "val")
        if op in ("TC_SWEEP_BATCH", "MOTIF_MATCH_3", "KCORE_DECOMPOSITION", "LOUVAIN_MODULARITY", "GRAPH_ISOMORPHISM"):
            from propgraph.sources.tables import simple_edges

            r = self._relation(a[-1])
            simple = simple_edges(r.edges)
            if op == "TC_SWEEP_BATCH":
                return structure.triangle_count(simple).head()[0]
            if op == "MOTIF_MATCH_3":
                return structure.motifs(simple)
            if op == "KCORE_DECOMPOSITION":
                return structure.core_numbers(simple, g.nodes(r.source)).withColumnRenamed("core", "val")
            if op == "LOUVAIN_MODULARITY":
                return structure.louvain_level(simple, g.nodes(r.source)).withColumnRenamed("label", "val")
            return structure.refined_colours(r.edges, g.nodes(r.source)).withColumnRenamed("colour", "val")
        if op == "BRANDES_FORWARD":
            return traversal.shortest_path_counts(self._relation(a[-1]).edges, self._set(a[0]))
        if op == "BRANDES_BACKWARD":
            r = self._relation(a[-1])
            return traversal.betweenness(r.edges, g.nodes(r.source), self._set(a[0]))
        if op == "DELTA_STEP_RELAX":
            return traversal.delta_stepping(self._relation(a[1]).edges, self._set(a[0]), float(self._get(a[2])), a[3].strip('"') if len(a) > 3 else "w").withColumnRenamed("dist", "val")
        if op == "READ_EDGE_WEIGHT":
            r = self._relation(a[1])
            return r.edges.join(self._set(a[0]).withColumnRenamed("id", "src"), "src", "left_semi")
        if op == "SAMPLE_NEIGHBORS":
            return sampling.sample_neighbours(self._relation(a[1]).edges, self._set(a[0]), [int(self._get(a[2]))]).select(F.col("tgt").alias("id")).distinct()
        if op == "RANDOM_WALK":
            return sampling.random_walks(self._relation(a[1]).edges, self._set(a[0]), int(self._get(a[2])))
        if op == "SCATTER_GATHER":
            return walk.scatter_gather(self._relation(a[1]).edges, self._vector(a[0]), F.col("val"), F.sum("message"))
        if op == "REBAC_CHECK":
            return int(not sets.intersect(self._set(a[0]), self._set(a[1])).isEmpty())
        if op == "COLLECT_ARRAY":
            return walk.collect_array(self._set(a[0])).head()[0]
        if op == "COLLECT_VALUE_MAP":
            return walk.collect_map(self._vector(a[0])).head()[0]
        if op == "MAP_DENSE_TO_KEYS":
            return walk.ids_to_keys(self._set(a[0]), g.nodes(self.program.names.get(a[1], a[1])))
        if op == "MAP_KEYS_TO_DENSE":
            return walk.keys_to_ids(g.spark.createDataFrame([(str(self._get(x)),) for x in a[:-1]], "key string"), g.nodes(self.program.names.get(a[-1], a[-1]))).select("id")
        if op == "INIT_MOCK_GRAPH":
            return g.spark.range(int(self._get(a[0])))
        if op == "PAGERANK":
            r = self._relation(a[-1])
            return ranking.pagerank(r.edges, g.nodes(r.source))
        raise ValueError(f"unknown instruction {op}")
