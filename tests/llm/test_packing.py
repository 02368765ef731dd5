import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from propgraph.llm.packing import Windows, pack, packing_query
from propgraph.llm.tokens import ChunkIds

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "don't I'LL say <|endoftext|>x a<|startoftext|>", "É́ ΑΣ ΣΑΣ. İstanbul ǅ ﬁ ½ ² ª 12,345.67 \x1c\x1d a\x85b\xa0c",
    "日本語テキスト 한국어 😀👍🏽 é", "a­b ​ zero​width ﷺ   x", "\x00 a", "naïve ſ ß ẞ Ŀ ŉ İ ĸ", "<|ENDOFTEXT|> _a_b 3²", "x" * 5000, "word " * 9000,
]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]


def test_ids_equal_the_tokenizers(spark, small):
    texts = ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for limit in (400_000, 50):  # a cache that is always full changes nothing
        ids = ChunkIds(PATH, limit)
        assert [ids.of(x) for x in texts] == whole(texts)


def check_pieces(docs, pieces, capacity):
    expected = {i: w + np.array([1], dtype="<u4").tobytes() for (i, _), w in zip(docs, whole([t for _, t in docs]), strict=True)}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.id, p.row), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert len(by_doc) == len(docs)
    for (ident, _), own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == expected[ident]
        assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1])
        assert {p.doc_tokens for p in own} == {len(expected[ident]) // 4}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1])
        assert sum(p.length for p in own) <= capacity
    return sum(p.length for p in pieces) / (capacity * len(by_sequence))


def test_pack_round_trip(spark, small):
    docs = list(enumerate(ODD)) + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    assert check_pieces(docs, pack(df, PATH).collect(), 2048) > 0.97
    assert check_pieces(docs, pack(df, PATH, capacity=64, windows=4).collect(), 64) > 0.85


def test_pack_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = pack(df, PATH).collect()
    assert sorted((r.id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert pack(df.filter("doc_id = 7"), PATH).count() == 0


def test_windows_are_bounded():
    out = []
    state = Windows(10, 3, 2, out.append)
    for k in range(200):
        state.add((k, k, 0, b"\0\0\0\0" * (k % 9 + 1), 0))
        assert len(state.open) <= 3
    assert all(sum(len(p[3]) // 4 for p in w) >= 9 for w in out)


def test_query_digests(spark, small):
    rows = packing_query(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {i: w + b"\1\0\0\0" for i, w in zip(texts, whole(texts.values()), strict=True)}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) for r in rows)


def test_ids_beyond_doubles_beside_null(spark):
    big = [2**53 + 1, 2**53 + 3, 2**63 - 1, None]
    df = spark.createDataFrame([(i, "a b") for i in big], "doc_id long, text string").coalesce(1)
    assert {r.id for r in pack(df, PATH).collect()} == set(big)
