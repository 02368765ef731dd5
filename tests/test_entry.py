"""The driver's contract, without the corpus queries."""

import __spark_entry__ as entry


def test_flagship(spark):
    assert entry.entry(spark).count() == 150


def test_names():
    every = entry.queries()
    assert set(entry.oracle_sql()) <= set(every) and len(every) > 100


def test_no_other_module_imports_the_corpus_package():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "propgraph"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"propgraph\.llm|from \.+llm", path.read_text()), path


def test_some_queries_against_duckdb(spark, small):
    import duckdb

    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in ("csr_walk", "mxv_plus_times", "roaring_bitmap_or", "triangles", "stats_degrees", "cypher_path", "degree_sort", "k_core", "merge_deltas"):
        df = queries[name](spark, small)
        columns = sorted(df.columns)
        got = sorted(tuple(r) for r in df.select(*columns).collect())
        assert got == sorted(con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({oracles[name]})").fetchall()), name
