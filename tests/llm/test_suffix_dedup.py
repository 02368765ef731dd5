import re
from collections import defaultdict

from pyspark.sql import functions as F

from propgraph.llm.suffix_dedup import LEAST, repeated_passages, suffix_query, without_passages


def brute(docs, least=LEAST):
    """Words of each document that lie in a run of ``least`` words which another document has too."""
    words = {i: [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for i, t in docs}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    out = {i: set() for i in words}
    for i, w in words.items():
        for k in range(len(w) - least + 1):
            if len(where[tuple(w[k : k + least])]) > 1:
                out[i].update(range(k, k + least))
    return out


def covered(spans):
    return {k for a, b in spans for k in range(a, b)}


def test_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = brute(docs)
    rows = {r.doc_id: r for r in suffix_query(spark, small).collect()}
    assert len(rows) == len(docs)
    got = {i: covered([tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]) for i, r in rows.items()}
    assert got == want
    assert any(want.values()) and not all(want.values())


def passage(tag, n):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_planted_passages_and_cut(spark):
    shared, short = passage("s", 57), passage("t", 49)
    data = [(k, f"{passage(f'a{k}x', 13 + k % 7)}\n{shared.upper() if k % 2 else shared}\t{passage(f'b{k}x', 21)}") for k in range(1, 40)]
    data += [(100 + k, f"{passage(f'c{k}x', 60)} {short} {passage(f'd{k}x', 60)}") for k in range(5)] + [(200, None), (201, ""), (None, shared), (202, passage("e", 300)), (202, passage("e", 300))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("cut", F.lit("clash")).repartition(5)
    found = repeated_passages(df)
    rows = {r.id: r for r in found.collect()}
    assert set(rows) == set(range(1, 40))
    for k, r in rows.items():
        assert [tuple(s) for s in r.spans] == [(13 + k % 7, 13 + k % 7 + 57)]
        assert [tuple(s) for s in r.cut] == ([] if k == 1 else [(13 + k % 7, 13 + k % 7 + 57)])
    left = {r.doc_id: r.text for r in without_passages(df.filter("doc_id < 100"), found).collect()}
    assert shared in left[1].lower() and not any(" s5 " in left[k].lower() for k in range(2, 40))
    assert left[4].split() == (passage("a4x", 17) + " " + passage("b4x", 21)).split()


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_of_one_id_and_frequent_seeds(spark):
    shared = passage("s", 70)
    docs = [(1, f"{passage('a', 40)} {shared}"), (2, shared), (2, f"{passage('b', 9)} {shared} {passage('c', 60)}"), (2, shared), (3, passage("z", 80))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, part string")
    for frequent in (1024, 3, 1):  # by neighbours, by shapes, by windows
        found = repeated_passages(df, frequent=frequent)
        got = sorted((r.id, [tuple(s) for s in r.spans], [tuple(s) for s in r.cut]) for r in found.collect())
        assert got == [(1, [(40, 110)], []), (2, [(0, 70)], [(0, 70)]), (2, [(9, 79)], [(9, 79)])]
        left = sorted((r.doc_id, r.text.split(), r.part) for r in without_passages(df, found).collect())
        want = [(1, docs[0][1].split(), "x"), (2, [], "x"), (2, [], "x"), (2, (passage("b", 9) + " " + passage("c", 60)).split(), "x"), (3, passage("z", 80).split(), "x")]
        assert left == want


def test_overlaps_on_one_side_of_a_seed(spark):
    """Twenty documents share a core of 49 words; each pair of them shares one more word, on its left or on its right."""
    core = passage("m", 49)
    docs = [(k, f"{passage(f'a{k}x', 30)} {'left' if k % 4 < 2 else 'own'}{k // 4 * 4} {core} {'right' if k % 4 >= 2 else 'own'}{k} {passage(f'b{k}x', 30)}") for k in range(20)]
    docs += [(100 + k, f"{passage(f'c{k}x', 30)} {core} right{k} {passage(f'd{k}x', 30)}") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = {i: w for i, w in brute(docs).items() if w}
    for frequent in (1024, 39, 5):
        got = spread(repeated_passages(df, frequent=frequent))
        assert {i: g[0] for i, g in got.items()} == want and len(want) > 20


def spread(found):
    return {r.id: (covered([tuple(s) for s in r.spans]), covered([tuple(s) for s in r.cut])) for r in found.collect()}


def test_every_occurrence_is_found(spark):
    shared, core = passage("s", 60), passage("m", 40)
    repeats = " ".join(f"{shared} {passage(f'x{k}x', 25)}" for k in range(9))
    # a frequent core; the documents of a pair share the 9 words before it and after it, too
    pairs = [(100 + k, f"{passage(f'a{k}x', 30)} {passage(f'l{k % 60}x', 9)} {core} {passage(f'r{k % 60}x', 9)} {passage(f'b{k}x', 30)}") for k in range(120)]
    docs = [(1, f"{passage('o', 20)} {shared}"), (2, repeats), *pairs]
    got = spread(repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    want = {i: w for i, w in brute(docs).items() if w}
    assert {i: g[0] for i, g in got.items()} == want
    assert len(want) == 122 and len(want[2]) == 9 * 60
    assert got[2][1] == want[2]


def test_first_holder_of_the_passage_keeps_it(spark):
    core, around = passage("m", 40), (passage("p", 30), passage("q", 30))
    docs = [(1, f"{passage('a', 60)} {core} {passage('b', 60)}")]  # holds the seeds of the passage, not the passage
    docs += [(k, f"{passage(f'c{k}x', 20)} {around[0]} {core} {around[1]} {passage(f'd{k}x', 20)}") for k in (2, 3, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = repeated_passages(df)
    got = spread(found)
    whole = set(range(20, 120))
    assert got == {2: (whole, set()), 3: (whole, whole), 4: (whole, whole)}
    left = {r.doc_id: r.text for r in without_passages(df, found).collect()}
    assert left[1] == docs[0][1] and left[2] == docs[1][1] and "m5" not in left[3].split()
