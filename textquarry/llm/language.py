"""Language identification by a string kernel of n-gram presence."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .worker import release, shared

PER_CLASS = 400  # labelled rows of each language to learn from, about
LANDMARKS = 40  # of them, landmarks of each language
RIDGE = 1e-2
FOLDS = 5
UNKNOWN = "und"
LEAST = 0.0  # a regression value of 0 is that of a text of any other language
_LETTER = regex.compile(r"\p{L}")
_BATCH = 256  # documents scored by one product
_SLAB = 1 << 20
_CODES = (1 << 8) + (1 << 16) + (1 << 24)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of FOLDS; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """Codes of all runs of one to three bytes of a lower-cased text in UTF-8, in which ASCII
    bytes other than letters read as spaces. Long texts come in overlapping slabs."""
    letters = shared("letters", _letters)
    for a in range(0, max(len(text), 1), _SLAB):
        raw = np.frombuffer(text[max(a - 2, 0) : a + _SLAB].lower().encode("utf-8", "replace"), np.uint8)
        one = letters[raw].astype(np.int32)
        two = (one[:-1] << 8) | one[1:]
        yield one
        yield two + (1 << 8)
        yield ((two[:-1] << 8) | one[2:]) + ((1 << 8) + (1 << 16))


def _letters() -> np.ndarray:
    keep = np.arange(256)
    keep[:128] = 32
    keep[97:123] = np.arange(97, 123)
    return keep.astype(np.uint8)


@dataclass
class KernelModel:
    """Languages, the codes that have a column, landmark rows over these columns (of length 1)
    and a weight per landmark and language."""

    languages: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def columns(self) -> np.ndarray:
        """Column of every code; codes that no landmark has share the last."""
        out = np.full(_CODES, len(self.codes), np.uint16)
        out[self.codes] = np.arange(len(self.codes), dtype=np.uint16)
        return out

    def scores(self, present: np.ndarray) -> np.ndarray:
        """Kernel with all landmarks, then the weights: two matrix products a batch."""
        length = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return (present @ self.landmarks.T) / length @ self.weights


def presence(texts: list[str], columns: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(texts), width + 1), np.float32)
    for i, text in enumerate(texts):
        for codes in gram_codes(text):
            out[i][columns[codes]] = 1
    return out[:, :width]


def fit(docs: DataFrame, per_class: int = PER_CLASS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """Learn from rows with text and lang whose id is not held out.

    Of each language about ``per_class`` rows are taken by a hash of their ids, a bounded
    sample, and their n-gram sets are brought to the driver; ``landmarks`` of them are the
    landmarks of the Nyström approximation. Rows of the kernel ridge regression, one language
    against the rest, weigh the same in total for each language.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, per_class / v))])[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [
                np.unique(np.concatenate([np.unique(c) for c in gram_codes(t.as_py())])) for t in batch.column("text")
            ]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "codes": sets},
                pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("codes", pa.list_(pa.int32()))]),
            )

    taken = rows.where(place < share).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    taken = taken.mapInArrow(grams, "doc_id long, lang string, codes array<int>").toArrow().sort_by("doc_id")
    languages, labels = np.unique(np.array(taken.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    sets = [np.array(x.as_py(), np.int64) for x in taken.column("codes")]
    if not sets:
        return None
    chosen = np.concatenate([np.flatnonzero(labels == c)[:landmarks] for c in range(len(languages))])
    codes, seen = np.unique(np.concatenate([sets[i] for i in chosen]), return_counts=True)
    if len(codes) >= 1 << 15:  # columns are numbered in 16 bits: the grams of most landmarks
        codes = np.sort(codes[np.argsort(-seen, kind="stable")[: (1 << 15) - 1]])
    x = np.zeros((len(sets), len(codes)), np.float32)
    for i, s in enumerate(sets):
        x[i, np.searchsorted(codes, s[np.isin(s, codes)])] = 1
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    marks = x[chosen]
    kernel, inner = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    weight = 1.0 / np.bincount(labels)[labels]
    target = (labels[:, None] == np.arange(len(languages))).astype(np.float64)
    left = kernel.T @ (kernel * weight[:, None]) + ridge * inner / len(chosen) + 1e-9 * np.eye(len(chosen))
    weights = np.linalg.solve(left, kernel.T @ (target * weight[:, None]))
    return KernelModel([str(v) for v in languages], codes, marks, weights.astype(np.float32))


def predictor(spark: SparkSession, model: KernelModel | None, keep: bool = True) -> Callable:
    """A column function: (lang_pred, score) of a text. Without ``keep`` workers hold nothing
    between tasks.

    ``und`` with score 0 where the text is null or has no letter, and everywhere without a
    model. The score is the winner's regression value, cut to 0..1; of equal values the first
    language in order wins.
    """
    parts = model and (model.languages, model.codes, model.landmarks, model.weights)
    sent, key = spark.sparkContext.broadcast(parts), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = KernelModel(*sent.value) if sent.value else None
        columns = shared("gram columns", m.columns, key) if m else None
        for series in batches:
            texts = series.tolist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            lettered = [i for i, t in enumerate(texts) if m and isinstance(t, str) and _LETTER.search(t)]
            for a in range(0, len(lettered), _BATCH):
                at = lettered[a : a + _BATCH]
                values = m.scores(presence([texts[i] for i in at], columns, len(m.codes)))
                best = values.argmax(axis=1)
                scores[at] = np.clip(values[np.arange(len(at)), best], 0, 1)
                for i, b in zip(at, best.tolist()):
                    names[i] = m.languages[b]
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        if not keep:
            release()

    return score


def predict(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row by its text alone, repeated rows included."""
    found = predictor(docs.sparkSession, model)(F.col("text").cast("string"))
    rows = docs.select("doc_id", found.alias("_found"))
    return rows.select("doc_id", "_found.lang_pred", "_found.score")


def with_known_language(docs: DataFrame, per_class: int = PER_CLASS, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language can be told: not those
    judged ``und``, nor those that no language claims with a score above ``least``.

    Rejection depends on a row's own text, so it is the rule of :func:`predict` and no join.
    Without a model, as no row has a usable label, all rows with a letter stay.
    """
    model = fit(docs, per_class)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    found = predictor(docs.sparkSession, model, keep=False)(F.col("text").cast("string"))
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] > least))


@query("op6_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``: null texts and texts without a letter are ``und`` with score
    0, null ids are not held out, repeated rows repeat, an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
