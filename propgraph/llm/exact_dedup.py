"""Exact dedup against a persistent digest index (DataFrame operations only).

A document's digest is the SHA-256 of its text without the characters ``[\\x20\\x09-\\x0D]``. The
index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest
(partial aggregation before the shuffle, so a hot digest is never gathered), sort-merge anti-joined
with the index and appended; what stays is then read back from the index. An index is opened again,
by this session or a later one, under its path.

Defined cases. Null text counts as empty; all empty texts are one group. A null id never wins over
another. Rows that repeat in all columns are one document for :meth:`DigestIndex.unique`, and all
of them carry the answer of their group in :meth:`DigestIndex.report`. An empty table gives an
empty result and leaves the index as it was. Texts of any length are digested whole. Columns of any
other name pass through unread.
A batch that is ingested twice gets the same answer twice, as the index remembers which id stays.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.operators.joins import lookup
from propgraph.plans.staging import new_path, staged


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without white space; null counts as empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.unhex(F.sha2(bare, 256))


class DigestIndex:
    """Digests seen so far and the id that stays for each, at ``path``.

    The number of buckets and the columns are kept in ``_index.json`` beside the data, so that any later
    session reads the same buckets; another number asked for is an error. One writer at a time: an
    append holds ``_writer``, created exclusively, and a second one raises until it is gone.
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_chars BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        about = self._described(buckets)
        if about["columns"] != self.COLUMNS:
            raise ValueError(f"the index at {path} has other columns: {about['columns']}")
        if buckets not in (None, about["buckets"]):
            raise ValueError(f"the index at {path} has {about['buckets']} buckets, not {buckets}")
        self.buckets = about["buckets"]
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        atexit.register(self.close)

    def _file(self, name: str):
        """(file system, path) of a file beside the data."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path, name)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _described(self, buckets: int | None) -> dict:
        """What the index says of itself; a new one is described first."""
        system, target = self._file("_index.json")
        if not system.exists(target):
            number = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            draft = self._file(f"_index-{uuid.uuid4().hex}.json")[1]
            stream = system.create(draft, False)
            stream.writeBytes(json.dumps({"buckets": number, "columns": self.COLUMNS}))
            stream.close()
            if not system.rename(draft, target):  # another session was first
                system.delete(draft, False)
        jvm = self.spark.sparkContext._jvm
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(target)))
        try:
            return json.loads(lines.readLine())
        finally:
            lines.close()

    def close(self) -> None:
        """Drops the session's name for the index; its files stay."""
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # the session may be gone already
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    @contextlib.contextmanager
    def _writer(self):
        system, target = self._file("_writer")
        try:
            system.create(target, False).close()
        except Exception as error:
            raise RuntimeError(f"another writer holds {target.toString()}; delete it if that writer is gone") from error
        try:
            self.spark.catalog.refreshTable(self.table)  # others may have appended
            yield
        finally:
            system.delete(target, False)
            self.spark.catalog.refreshTable(self.table)

    def _append(self, groups: DataFrame) -> None:
        """Adds the digests that are new; one file per bucket, so that each is sorted throughout.

        A failed append leaves nothing that is read, and the batch can be ingested again.
        """
        with self._writer():
            new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
            new = new.select("digest", "keep_id", "keep_chars").repartition(self.buckets, "digest")
            new.write.insertInto(self.table)

    def _groups(self, narrow: DataFrame) -> DataFrame:
        best = F.max(F.struct("chars", F.bitwise_not("id").alias("inverse"))).alias("best")  # most characters, then least id
        return narrow.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")).select(
            "digest", F.bitwise_not("best.inverse").alias("keep_id"), F.col("best.chars").alias("keep_chars"), "group_size"
        )

    def _narrow(self, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
        text = F.coalesce(docs[text_column], F.lit(""))
        return docs.select(docs[id_column].cast("long").alias("id"), F.length(text).cast("long").alias("chars"), digest(text).alias("digest"))

    def report(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Ingests ``docs``; one row per row: id, digest, keep_id, group_size (in this batch), kept."""
        narrow = staged(self._narrow(docs, id_column, text_column), "digests")
        groups = staged(self._groups(narrow), "digest-groups")
        self._append(groups)
        answer = groups.select("digest", "group_size").join(self.rows().select("digest", "keep_id").hint("merge"), "digest")
        found = lookup(narrow, answer, "digest", "group_size", narrow.count())
        return found.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))

    def unique(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """Ingests ``docs`` and returns the rows that stay, with their columns.

        Rows are reduced per digest before their one shuffle, so copies do not travel; what the index
        knows is settled on digests and ids alone.
        """
        groups = staged(self._groups(self._narrow(docs, id_column, text_column)), "digest-groups")
        self._append(groups)
        known = self.rows().select("digest", F.col("keep_id").alias("known")).hint("merge")
        seen = groups.join(known, "digest").filter(~F.col("keep_id").eqNullSafe(F.col("known"))).select("digest")
        seen = staged(seen, "digests-seen")
        text = F.coalesce(docs[text_column], F.lit(""))
        ident = docs[id_column].cast("long")
        row = F.struct(*[docs[c] for c in docs.columns])
        rest = F.xxhash64(*[docs[c] for c in docs.columns])
        order = F.struct(F.length(text), F.bitwise_not(ident), rest)
        best = docs.groupBy(digest(text).alias("digest")).agg(F.max_by(row, order).alias("row"))
        if not seen.isEmpty():
            best = best.join(seen, "digest", "left_anti")
        return best.select("row.*")


def exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = DigestIndex(spark, new_path(spark, "digest-index")).report(docs)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents),
g AS (
  SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
