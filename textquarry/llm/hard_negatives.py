"""Hard negatives by slot-decomposed selection: one pass answers the windows of all positives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small, staged
from ..session import shared_folder
from .registry import query, table

CHUNK = 2048  # vectors of a chunk
BLOCK = 256  # anchors of a block, about
PASS_BYTES = 16 * 1024 * 1024  # of anchors' components that a pass over the chunks broadcasts
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # per cent of the positive's score
ANCHOR_STEP = 50
SCALE = 256

_NONE = np.iinfo(np.int64).min
_EXACT = 2.0**53
_BEST = "id long, slot int, vec_id long, score long"
# slots(scores, anchors, ids, labels): of each anchor (row) and vector (column) the slot, or -1
_Slots = Callable[[np.ndarray, pa.StructArray, np.ndarray, np.ndarray], np.ndarray]


def labelled_vectors(rows: DataFrame, key: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, v): floor(scale * x) of every component. Rows whose key, label, vector or a
    component is null or not finite take no part, and neither do empty vectors. Of rows that
    repeat a key the one with the smallest label, then the smallest vector, counts."""
    x = F.col(vector)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    usable = F.col(key).isNotNull() & label.isNotNull() & (F.size(x) > 0) & ~odd
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    whole = rows.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    # Only vectors whose key repeats are shuffled.
    repeated = staged(whole.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-keys")
    repeated = broadcast_if_small(repeated)
    first = whole.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("least"))
    return whole.join(repeated, "id", "left_anti").unionByName(first.select("id", "least.*"))


def _chunks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of one length packed as arrays, by id inside a chunk."""
    schema = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "labels", "vectors"))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                same = same.take(pc.sort_indices(same.column("id")))
                for a in range(0, same.num_rows, size):
                    part = same.slice(a, size)
                    arrays = part.column("id"), part.column("label"), part.column("v").flatten()
                    held = [[x.to_numpy(zero_copy_only=False).astype("<i8").tobytes()] for x in arrays]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array(h, pa.binary()) for h in held)], schema=schema)

    return vectors.select("id", "label", "v").mapInArrow(pack, "dim int, ids binary, labels binary, vectors binary")


def in_passes(anchors: DataFrame, block: int, pass_bytes: int) -> Iterator[DataFrame]:
    """Anchors (id, v, ...) in blocks of one vector length, in groups that a pass broadcasts: a
    group's components take ``pass_bytes`` and at most one block more."""
    dim = F.size("v").alias("dim")
    counts = anchors.groupBy(dim).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = anchors.withColumn("dim", dim).join(broadcast_if_small(staged(counts, "anchor-lengths")), "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("dim", "block").agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors"))
    blocks = staged(blocks, "anchor-blocks")
    sizes = blocks.select("dim", "block", (F.size("anchors").cast("long") * F.col("dim") * 8).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("dim", "block")) - F.col("bytes")
    sizes = staged(sizes.select("dim", "block", F.floor(before / pass_bytes).cast("int").alias("nth")), "anchor-passes")
    last = sizes.agg(F.max("nth").alias("nth")).first()["nth"]
    for nth in range(0 if last is None else last + 1):
        yield blocks.join(broadcast_if_small(sizes.where(F.col("nth") == nth)), ["dim", "block"]).drop("nth")


class _Combiner:
    """The ``k`` best (score, then smaller id) of every (anchor, slot) of a block so far."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full((anchors, slots), _NONE, np.int64)  # a kth score, once there is one

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        asked = np.maximum(slot, 0)
        row, column = np.nonzero((slot >= 0) & (score >= np.take_along_axis(self.least, asked, axis=1)))
        if not len(row):
            return
        group = np.concatenate([self.group, row * self.slots + asked[row, column]])
        score = np.concatenate([self.score, score[row, column]])
        ids = np.concatenate([self.id, ids[column]])
        order = np.lexsort((ids, -score, group))
        group = group[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        keep = order[place < self.k]
        self.group, self.score, self.id = group[place < self.k], score[keep], ids[keep]
        full = place == self.k - 1
        self.least.reshape(-1)[group[full]] = score[order[full]]


def _best(chunks: DataFrame, anchors: DataFrame, slots: _Slots, n_slots: int, k: int, block: int, pass_bytes: int) -> DataFrame:
    """(id, slot, vec_id, score): the ``k`` best of every anchor and slot over all chunks.

    Every pass reads the chunks where they are, beside a broadcast group of anchor blocks. A
    task keeps the k best of each (anchor, slot) through its partition, and only these meet
    in the shuffle.
    """
    spark = chunks.sparkSession
    folder = shared_folder(spark, f"slots-{uuid.uuid4().hex[:12]}")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, _Combiner]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim, number = batch.column("dim")[i].as_py(), batch.column("block")[i].as_py()
                asked = batch.column("anchors")[i].values
                own = asked.field("id").to_numpy(zero_copy_only=False)
                q = asked.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                ids, labels, v = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("ids", "labels", "vectors"))
                score = _products(q, v.reshape(-1, dim))
                if (dim, number) not in held:
                    held[dim, number] = own, _Combiner(len(own), n_slots, k)
                _, best = held[dim, number]
                slot = slots(score, asked, ids, labels)
                slot[own[:, None] == ids[None, :]] = -1
                best.add(slot, score, ids)
        for own, best in held.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[best.group // n_slots]), pa.array((best.group % n_slots).astype(np.int32)), pa.array(best.id), pa.array(best.score)],
                ["id", "slot", "vec_id", "score"],
            )

    for group in in_passes(anchors, block, pass_bytes):
        # Equal lengths meet: the group is at most PASS_BYTES and a block, so this is no cross join.
        beside = chunks.join(F.broadcast(group), "dim").select("dim", "block", "anchors", "ids", "labels", "vectors")
        beside.mapInArrow(combine, _BEST).write.mode("append").parquet(folder)
        spark.catalog.refreshByPath(folder)
    try:
        found = spark.read.schema(_BEST).parquet(folder)
    except Exception as e:  # noqa: BLE001
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _BEST)
    order = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, by doubles where these are exact."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * v.shape[1]
    if largest < _EXACT:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def hard_negatives(
    vectors: DataFrame,
    anchors: DataFrame,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    chunk: int = CHUNK,
    block: int = BLOCK,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` and ``anchors`` are (id, label, v) of ``labelled_vectors``; v are arrays of
    integers, a score is the inner product with the anchor, which vectors of another length
    do not have. An anchor's positives are the ``positives`` best other vectors of its label.
    Each gets the ``negatives`` best vectors of other labels with low * p <= 100 * score <=
    high * p, p being the positive's score. Ties go to the smaller id. Anchors without
    positives and positives without negatives have no rows; empty tables give none.

    The upper limits of an anchor's positives split scores into disjoint slots. One pass
    keeps the best of each slot; a positive's window begins with its own slot and goes on
    through the lower ones, so the best of these in descending order, cut at the window's
    lower end, are its negatives, however many windows overlap.
    """
    chunks = staged(_chunks(vectors, chunk), "vector-chunks")
    anchors = staged(anchors.select("id", "label", "v"), "anchors")

    def same_label(score: np.ndarray, asked: pa.StructArray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        own = asked.field("label").to_numpy(zero_copy_only=False)
        return np.where(own[:, None] == labels[None, :], 0, -1)

    chosen = _best(chunks, anchors, same_label, 1, positives, block, pass_bytes)
    score = F.col("score")
    chosen = chosen.select(
        "id", F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
        F.expr(f"(score * {high} - pmod(score * {high}, 100L)) div 100").alias("upper"),
        F.expr(f"-((-score * {low} - pmod(-score * {low}, 100L)) div 100)").alias("lower"),
    )
    chosen = staged(chosen.where("lower <= upper"), "positives")
    windows = chosen.groupBy("id").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least")
    )
    asking = anchors.join(windows, "id")

    def slot_of(score: np.ndarray, asked: pa.StructArray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
        own, least = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("label", "least"))
        limits = asked.field("limits").to_pylist()
        slot = np.full(score.shape, -1)
        for j in range(positives):
            limit = np.array([x[j] if j < len(x) else _NONE for x in limits], np.int64)
            slot += (score <= limit[:, None]) & (limit > _NONE)[:, None]
        slot[(own[:, None] == labels[None, :]) | (score < least[:, None])] = -1
        return slot

    best = _best(chunks, asking, slot_of, positives, negatives, block, pass_bytes)
    # At most positives * negatives rows an anchor.
    ladder = best.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("slot", (-score).alias("down"), "vec_id", "score"))).alias("ladder")
    )
    own_slot = (F.array_position("limits", F.col("upper")) - 1).alias("own_slot")
    asked = chosen.join(windows.select("id", "limits"), "id").select("id", "positive_id", "positive_score", "lower", own_slot)
    window = F.slice(F.filter("ladder", lambda x: x["slot"] >= F.col("own_slot")), 1, negatives)
    out = asked.join(ladder, "id").select("*", F.posexplode(window).alias("place", "one")).where("one.score >= lower")
    return out.select(
        F.col("id").alias("anchor_id"), "positive_id", (F.col("place") + 1).alias("rank"),
        F.col("one.vec_id").alias("negative_id"), "positive_score", F.col("one.score").alias("negative_score"),
    )


SQL = f"""WITH r AS (SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY label, v) = 1),
s AS (SELECT a.id AS anchor_id, c.id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.id <> c.id AND len(a.v) = len(c.v) WHERE a.id % {ANCHOR_STEP} = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 100 * s.score BETWEEN {LOW} * positive_score AND {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""


@query("op11_hard_negatives", SQL)
def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whose vec_id is divisible by ANCHOR_STEP is an anchor, against all. Rows
    with nulls or non-finite components take no part; an empty table gives no row."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives(vectors, vectors.where(F.col("id") % ANCHOR_STEP == 0))
