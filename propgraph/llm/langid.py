"""Language identification by mixture inference.

Each language has a model of character trigrams (letters in lower case, runs of other characters as
one boundary), hashed to 2^16 buckets. A document's language proportions come from expectation-
maximisation over its trigrams; languages are then taken out of the set as long as the likelihood,
less a penalty for each language, does not fall. The prediction is the largest proportion.

The models are fitted on at most ``TRAIN_DOCS`` labelled documents of each language, chosen by a
hash of the id, with their whole texts; documents whose crc32(id) is divisible by 5 are held out.

Defined cases. Null text and text without letters is ``und`` with score 0, and so is everything if
there is nothing to learn from. Documents with null id or null language are not learned from.
Ties go to the language first in code point order. Rows that repeat get equal results. An empty table
gives an empty result. Texts of any length are read whole. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propgraph.llm.batches import cut, release, rows

BUCKETS = 1 << 16
TRAIN_DOCS = 2000
#: Pseudo-count of each bucket.
SMOOTH = 0.05
#: Nats that another language must gain for each trigram of the document, besides half the log of their number.
PENALTY = 0.02
ROUNDS, TOLERANCE = 25, 1e-3
UNKNOWN = "und"

_IS_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _IS_LETTER:
        _IS_LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _IS_LETTER[0]


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of a text's trigrams, in order; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    points = np.where(is_letter, points, np.uint32(0))
    points = np.concatenate(([0], points[is_letter | np.concatenate(([False], is_letter[:-1]))], [0])).astype(np.uint64)
    code = (points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (code >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages

    def infer(self, grams: np.ndarray) -> tuple[str, float, dict[str, float]]:
        """(language, its proportion, all proportions of the selected set)."""
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0, {}
        seen, count = np.unique(grams, return_counts=True)
        logs = self.logs[seen]
        top = logs.max(axis=1, keepdims=True)
        like, base = np.exp(logs - top), float(count @ top[:, 0])
        cost = 0.5 * np.log(len(grams)) + PENALTY * len(grams)
        chosen = np.arange(len(self.languages))
        share, fit = _mixture(like, count)
        alone = count @ (logs - top)
        while len(chosen) > 1:
            if fit - alone[chosen].max() < cost:  # no set of several can make up for the cost of a second one
                best = chosen[int(alone[chosen].argmax())]
                chosen, share = np.array([best]), np.ones(1)
                break
            keep = np.delete(np.arange(len(chosen)), share.argmin())
            less, fit_less = _mixture(like[:, chosen[keep]], count)
            if fit - fit_less >= cost:
                break
            chosen, share, fit = chosen[keep], less, fit_less
        k = int(share.argmax())
        return self.languages[chosen[k]], float(share[k]), {self.languages[c]: float(s) for c, s in zip(chosen, share, strict=True)}


def _mixture(like: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that fit counts best, and the log likelihood, by expectation-maximisation."""
    share, total = np.full(like.shape[1], 1 / like.shape[1]), count.sum()
    for _ in range(ROUNDS):
        mixed = like @ share
        new = share * ((count / mixed) @ like) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, float(count @ np.log(like @ share))


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, id_column: str, text_column: str, label_column: str, most: int = TRAIN_DOCS) -> DataFrame:
    """(label, text): at most ``most`` documents of each label that are not held out, by the least hash."""
    known = docs.filter(~held_out(docs[id_column]) & docs[label_column].isNotNull() & docs[text_column].isNotNull())
    known = known.select(docs[label_column].cast("string").alias("label"), docs[text_column].alias("text"), F.shiftrightunsigned(F.xxhash64(docs[id_column]), 11).alias("h"))
    share = known.groupBy("label").agg(F.least(F.lit(1.0), 1.5 * most / F.count(F.lit(1)) + 0.0).alias("share"))
    # one row a label, while the models hold 2^16 numbers for each
    near = known.join(F.broadcast(share), "label").filter(F.col("h") <= F.col("share") * float(1 << 53))  # so a window sees a bounded number of rows
    first = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
    return near.withColumn("_rank", first).filter(F.col("_rank") <= most).select("label", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for label, text in rows(batches):
        have = total.setdefault(label, np.zeros(BUCKETS, dtype=np.int64))
        have += np.bincount(trigrams(text), minlength=BUCKETS)
    for label, counts in total.items():
        yield pa.RecordBatch.from_pydict({"label": [label], "counts": [counts.astype("<i8").tobytes()]})


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model:
    """The languages' models; the driver gets one vector of 2^16 counts a language and training task."""
    total: dict[str, np.ndarray] = {}
    parts = training_rows(docs, id_column, text_column, label_column).coalesce(8).mapInArrow(_counted, "label string, counts binary")
    for row in parts.toLocalIterator():
        total[row.label] = total.get(row.label, 0) + np.frombuffer(row.counts, dtype="<i8")
    languages = sorted(k for k, v in total.items() if v.sum())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    counts = np.stack([total[k] for k in languages], axis=1) + SMOOTH
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float64))


_ANSWER = pa.struct([("pred", pa.string()), ("score", pa.float64()), ("shares", pa.map_(pa.string(), pa.float64()))])


def _answer(model: Model, text: str | None) -> dict:
    pred, score, shares = model.infer(trigrams(text))
    return {"pred": pred, "score": score, "shares": list(shares.items())}


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_shares (proportions of the selected languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_shares")]

    @F.arrow_udf("pred string, score double, shares map<string, double>")
    def infer(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            found = [pa.array([_answer(shared.value, t) for t in part.to_pylist()], _ANSWER) for part in cut(array)]
            array = None
            yield pa.concat_arrays(found) if found else pa.array([], _ANSWER)
            found = None
        release()

    own = "_lang" + "_" * max(map(len, docs.columns))  # a name that no column has
    judged = docs.select(*kept, infer(docs[text_column]).alias(own))
    return judged.select(*kept, F.col(f"{own}.pred").alias("lang_pred"), F.col(f"{own}.score").alias("lang_score"), F.col(f"{own}.shares").alias("lang_shares"))


def langid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
