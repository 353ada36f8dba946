"""Vector expressions and embedding functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .basics import ColumnOrName, col, let

EmbedFn = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"[a-z0-9_]+")
_KNOWN_WORDS = 1 << 16
_VECTORS = pa.list_(pa.float32())


def norm(vector: ColumnOrName) -> Column:
    return F.sqrt(
        F.aggregate(col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def normalize(vector: ColumnOrName) -> Column:
    """L2-normalised vector; an all-zero vector stays as it is."""
    v = col(vector)
    return let(
        norm(v),
        lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)),
    )


def mean_of(vector: ColumnOrName, dim: int) -> Column:
    """Aggregate: element-wise mean of ``dim``-long vectors.

    One plain average per position, so it combines on the map side; exploding the vectors
    would multiply the shuffled rows by their length.
    """
    v = col(vector)
    return F.array(*[F.avg(v[i].cast("double")) for i in range(dim)])


class _HashingEmbedder:
    """Callable that sums signed one-hot slots of the words of each text."""

    def __init__(self, dim: int, unit: bool):
        self.dim, self.unit, self.slots = dim, unit, {}

    def __getstate__(self):
        return {"dim": self.dim, "unit": self.unit, "slots": {}}

    def slot(self, word: str) -> int:
        """Slot of a word, mirrored into the second half for a negative sign."""
        at = self.slots.get(word)
        if at is None:
            h = hashlib.md5(word.encode()).hexdigest()
            at = int(h[:8], 16) % self.dim + (self.dim if int(h[8], 16) % 2 else 0)
            if len(self.slots) >= _KNOWN_WORDS:
                self.slots.clear()
            self.slots[word] = at
        return at

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            slots = np.array([self.slot(w) for w in _WORD.findall(text.lower())], dtype="int64")
            counts = np.bincount(slots, minlength=2 * self.dim)
            out[row] = counts[: self.dim] - counts[self.dim :]
        if self.unit:
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norms == 0, 1.0, norms)
        return out.astype("float32")


def hashing_embedder(dim: int = fixed.VECTOR_DIM, unit: bool = True) -> EmbedFn:
    """Deterministic bag-of-words embedding by feature hashing, L2-normalised on demand."""
    return _HashingEmbedder(dim, unit)


def embedder(
    make: Callable[[], EmbedFn],
    *,
    batch: int = 64,
    sort_by_length: bool = True,
    on_error: str = "raise",
):
    """Vectorised embedding column function.

    ``make`` runs once per Python worker and returns the model's batch function. Texts of
    an Arrow batch are taken in order of length, so that a padded model batch holds texts
    of like size, and results go back to their own rows. Only the texts of one model batch
    are strings at a time. With ``on_error="null"`` the texts
    of a model batch that fails get no vector, and the rest goes on.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for texts in parts:
            order = np.arange(len(texts))
            if sort_by_length:
                lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
                order = np.argsort(lengths, kind="stable")
            found = []
            for at in range(0, len(order), batch):
                found.append(_batch_vectors(fn, texts.take(pa.array(order[at : at + batch])), on_error))
            back = np.empty(len(order), dtype="int64")
            back[order] = np.arange(len(order))
            yield pa.concat_arrays(found).take(pa.array(back)) if found else pa.array([], _VECTORS)

    return embed


def _batch_vectors(fn: EmbedFn, texts: pa.Array, on_error: str) -> pa.Array:
    """Vectors of one model batch, whose texts alone become strings."""
    try:
        vectors = fn(texts.fill_null("").to_pylist())
        if len(vectors) != len(texts):
            raise ValueError("the embedding function must return one vector per text")
    except Exception:
        if on_error != "null":
            raise
        return pa.nulls(len(texts), _VECTORS)
    rows = [np.asarray(v, dtype="float32") for v in vectors]
    ends = np.cumsum([0, *map(len, rows)]).astype("int32")
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows), from_pandas=True))
