"""Bottom-k document fingerprints (DataFrame functions only).

A text's shingles are its runs of five words (``[^\\x20\\x09-\\x0D]+``), or the whole sequence if it
has fewer; the sketch keeps the ``k`` smallest of their distinct 64-bit hashes, in order. Sketches of
parts merge to the sketch of the whole set and estimate resemblance, containment and the number
of distinct shingles; up to ``k`` shingles they are exact.

Defined cases. Null text counts as empty; a text without words has the empty sketch. Two empty
sketches resemble each other fully, an empty and another not at all. Rows that repeat get equal
sketches. Texts of any length give sketches of bounded size, from all of their shingles. An empty table gives
an empty result. Null keys of :func:`merge_parts` form a group. Columns of any other name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS, SKETCH = 5, 256
_BLANK = " \t\n\x0b\x0c\r"


def with_fingerprint(df: DataFrame, text: Column, name: str, k: int = SKETCH) -> DataFrame:
    """``df`` with the sketch of ``text`` as column ``name`` (array of bigint, ascending)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    hashes = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    words = F.when(F.length(trimmed) > 0, hashes).otherwise(F.expr("cast(array() AS array<bigint>)"))

    def of(w: Column) -> Column:
        n = F.size(w)
        shingles = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))
        short = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.expr("cast(array() AS array<bigint>)"))
        return F.when(n >= WORDS, shingles).otherwise(short)

    # the words are bound to a variable, so that no rule of the optimizer can put their expression in each of its places
    every = F.get(F.transform(F.array(words), of), F.lit(0))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(every)), 1, k))


def merged(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated intersection over union."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = SKETCH) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    rank = F.element_at(a, k).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    union = distinct_shingles(merged(a, b, k), k)
    share = resemblance(a, b, k) * union / F.nullif(distinct_shingles(a, k), F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), share), F.lit(1.0))


def merge_parts(parts: DataFrame, key: str, sketch: str, k: int = SKETCH, salts: int = 64) -> DataFrame:
    """One sketch per key from many; a hot key is first reduced in ``salts`` independent groups."""
    rows = parts.select(parts[key].alias("key"), F.explode(parts[sketch]).alias("h")).withColumn("salt", F.pmod("h", F.lit(salts))).distinct()
    for group in (["key", "salt"], ["key"]):
        order = Window.partitionBy(*group).orderBy("h")
        rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    keys = parts.select(parts[key].alias("whose")).distinct()
    out = rows.groupBy("key").agg(F.sort_array(F.collect_list("h")).alias("least"))
    joined = keys.join(out, keys["whose"].eqNullSafe(out["key"]), "left")
    return joined.select(F.col("whose").alias(key), F.coalesce("least", F.expr("cast(array() AS array<bigint>)")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """A sketch as hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def range_bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by binary search; -1 for null."""
    steps = [1 << b for b in reversed(range(max(1, len(bounds)).bit_length()))]
    padded = [*bounds, *[2**63 - 1] * (2 * steps[0] - 1 - len(bounds))]
    array = F.array(*[F.lit(b).cast("long") for b in padded]) if len(padded) < 64 else F.from_json(F.lit(str(padded)), "array<bigint>")
    def step(at: Column, s: Column) -> Column:
        return F.when(F.get(array, at + s - 1) <= value, at + s).otherwise(at)
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)
    return F.when(value.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, id_column: str, text_column: str, buckets: int, add) -> DataFrame:
    """Each row with ``following``: the added columns of the row with the next id, the first after the last.

    Ids are cut into ranges of about equal numbers of rows; each range also gets a copy of the
    first row of the next one. So a window within the ranges finds every neighbour, the texts are
    shuffled once and no task sees all rows. ``add(df)`` adds columns after that shuffle. Rows of
    equal id follow each other in the order of their texts.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_column].alias("id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    shares = [(i + 1) / buckets for i in range(buckets - 1)]
    bounds = base.agg(F.percentile_approx("id", shares, 10 * buckets)).head()[0] or []
    base = base.withColumn("range", range_bucket(F.col("id"), sorted(set(bounds))))
    order = F.struct(F.col("id").isNotNull(), "id", "text")
    firsts = base.groupBy("range").agg(F.min(order).alias("first"))
    have = sorted(r[0] for r in base.select("range").distinct().collect())
    before = spark.createDataFrame([(have[i], have[i - 1]) for i in range(len(have))], "range int, earlier int")
    ghosts = firsts.join(before, "range").select(F.col("first.id").alias("id"), F.col("first.text").alias("text"), F.col("earlier").alias("range"), F.lit(1).alias("ghost"))
    rows = base.withColumn("ghost", F.lit(0)).unionByName(ghosts).repartition("range")
    rows = add(rows)
    extra = [c for c in rows.columns if c not in ("id", "range", "ghost")]
    sequence = Window.partitionBy("range").orderBy("ghost", F.col("id").asc_nulls_first(), "text")
    return rows.withColumn("following", F.lead(F.struct(*extra)).over(sequence)).filter("ghost = 0")


def fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, "doc_id", "text", buckets, lambda df: with_fingerprint(df, F.col("text"), "print"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("following.text"), F.lit(1), half))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "print", F.col("following.print").alias("next_print"))
    rows = with_fingerprint(rows, F.col("edited"), "edited_print")
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        resemblance(F.col("print"), F.col("edited_print")).alias("near_edited"), resemblance(F.col("print"), F.col("next_print")).alias("near_next"),
    )
