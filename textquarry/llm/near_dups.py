"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small, staged
from .components import connected_components
from .registry import query, table
from .rows import fresh
from .words import mix, shingle_sets, word_hashes
from .worker import released, row_slices, shared, text_buffers

WORDS = 5
PERCENT = 75
HALVES = 16  # smaller collections; every two of them form a table
PER_HALF = 2  # minhashes of a collection
FIRST_HALVES = 8  # collections whose tables are tried before the others
_SLICE = 1 << 21
_WIDE = 1 << 14
COMPARED = 512  # members of a block
_COLUMNS = 4096
_ENTRY_ROWS = 1 << 15

_SIGNATURES = "doc_id long, n_shingles long, digest_a long, digest_b long, halves array<long>"


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    n = HALVES * PER_HALF
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per collection of PER_HALF minhashes. HALVES * PER_HALF hash functions
    serve HALVES * (HALVES - 1) / 2 tables of 2 * PER_HALF minhashes each."""
    times, plus = shared("minhash functions", _functions)
    least = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), _WIDE):
        part = shingles[None, a : a + _WIDE] * times[:, None] + plus[:, None]
        np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1), out=least)
    keys = np.zeros(HALVES, np.uint64)
    for j in range(PER_HALF):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[j::PER_HALF])
    return keys


def signatures(docs: DataFrame) -> DataFrame:
    """Of each row the size of its shingle set, a 128-bit digest of the set and the half keys;
    these are null where the set is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                sets = shingle_sets(*word_hashes(*text_buffers(batch.column("text"))), WORDS)
                digests = [_digest(s) if len(s) else (None, None) for s in sets]
                keys = [half_keys(s).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest_a", "digest_b", "halves"],
                )

    return rows.mapInArrow(released(sign), _SIGNATURES)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    a = mix(shingles ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
    b = mix(shingles + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets share at least ``percent`` in a
    hundred of their union."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(ids), "doc_id", "left_semi")
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, np.ndarray] = (None, np.zeros(0, np.uint64))
        for whole in batches:
            for batch in row_slices(whole, "text_a", _SLICE):
                other = shingle_sets(*word_hashes(*text_buffers(batch.column("text_a"))), WORDS)
                keep = []
                for i in range(batch.num_rows):
                    text = batch.column("text_b")[i].as_py()
                    if last[0] != text:
                        one = pa.array([text], pa.string())
                        last = (text, shingle_sets(*word_hashes(*text_buffers(one)), WORDS)[0])
                    mine, yours = other[i], last[1]
                    common = len(np.intersect1d(mine, yours, assume_unique=True))
                    keep.append(100 * common >= percent * (len(mine) + len(yours) - common) > 0)
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(released(confirm), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Words are runs outside \\x20 and \\x09-\\x0D with A-Z lower-cased; a set has the distinct
    5-word shingles, of fewer words the whole sequence. Documents are linked where the sets
    share ``percent`` in a hundred of their union; a component is named by its smallest
    doc_id, whose rows are kept. Rows without words, and rows without a doc_id, are linked
    with nothing and kept (component_id is their doc_id). Rows that repeat a doc_id are one
    document: its texts are in one component. Other columns are not read.

    Equal sets form a class at once, and its smallest doc_id stands for it. Tables are keyed
    by every two of the HALVES half keys; in a table's bucket each document is a candidate
    with the smallest one there, then with the most linked one. Buckets that still hold more
    than one component are compared block by block, without those members that have too few
    shingles in common with anyone. So a group of copies costs a pair per member and bucket,
    and of two documents that meet in a bucket none is left untested unless they are in one
    component or cannot be linked. Two documents at the bound meet in none of the tables with
    a probability of 4 in 100 000.
    """
    signed = staged(signatures(docs), "signatures")
    node = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("doc_id"))
    several = (
        signed.where(node.isNotNull())
        .groupBy("digest_a", "digest_b")
        .agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest_a", "digest_b", "class")
    )
    several = broadcast_if_small(staged(several, "classes"))
    rows = signed.join(several, ["digest_a", "digest_b"], "left").withColumn(
        "node", F.when(node.isNotNull(), F.coalesce("class", node))
    )
    rows = staged(rows.select("doc_id", "n_shingles", "node", "halves"), "nodes")
    links = staged(_same_id(rows).unionByName(_table_links(rows, docs, percent)), "near-links")
    component = connected_components(links)
    out = rows.join(broadcast_if_small(component), "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one document of each group stays."""
    judged = near_duplicates(docs, percent)
    (name,) = fresh(docs, "gone")
    gone = staged(judged.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return docs.join(broadcast_if_small(gone), docs["doc_id"].cast("long") == F.col(name), "left_anti")


def _same_id(rows: DataFrame) -> DataFrame:
    """Links between the classes of texts that share a doc_id."""
    ids = rows.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    ids = ids.where("a < b").select("doc_id", "a")
    return rows.join(ids, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))


def _table_links(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between documents that meet in a table's bucket."""
    heads = rows.where("node = doc_id").select("node", "halves")
    # Every row becomes HALVES * (HALVES - 1) / 2 entries, so tasks are cut by rows, not by bytes.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _ENTRY_ROWS))
    heads = heads.repartition(tasks)
    half = [F.col("halves")[i] for i in range(HALVES)]
    keys = [
        F.struct(F.lit(i >= FIRST_HALVES).alias("later"), F.xxhash64(F.lit(i * HALVES + j), half[i], half[j]).alias("key"))
        for i in range(HALVES)
        for j in range(i)
    ]
    entries = heads.select("node", F.explode(F.array(*keys)).alias("entry")).select("node", "entry.later", "entry.key")
    shared_keys = entries.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared_keys = shared_keys.where("first < last").select("key", "first")
    members = staged(entries.join(shared_keys, "key"), "buckets")

    def more(found: DataFrame, pairs: DataFrame) -> DataFrame:
        new = confirmed(staged(pairs.distinct(), "pairs"), docs, percent)
        return staged(found.unionByName(new).distinct(), "confirmed")

    stars = members.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"), "later")
    found = staged(confirmed(staged(stars.where("NOT later").select("a", "b").distinct(), "pairs"), docs, percent), "confirmed")
    component = connected_components(found)
    found = more(found, _parted(stars.where("later").select("a", "b").distinct(), component))
    # Buckets with one smallest member are one group from here on: a group of near copies shares
    # most of its buckets, and all that meet in a bucket still meet.
    groups = staged(members.select(F.col("first").alias("key"), "node").distinct(), "groups")
    apart = _apart(groups, found)
    if apart is None:
        return found
    apart = _linkable(apart, rows, docs, percent)
    found = more(found, _to_most_linked(apart, found))
    again = _apart(apart.drop("component"), found)
    if again is None:
        return found
    return staged(found.unionByName(_across(again, docs, percent)).distinct(), "confirmed")


def _with_component(nodes: DataFrame, component: DataFrame, node: str, name: str) -> DataFrame:
    component = component.select(F.col("node").alias(node), F.col("component").alias(name))
    joined = nodes.join(broadcast_if_small(component), node, "left")
    return joined.withColumn(name, F.coalesce(name, node))


def _parted(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs whose members are not in one component yet."""
    both = _with_component(_with_component(pairs, component, "a", "ca"), component, "b", "cb")
    return both.where("ca <> cb").select("a", "b")


def _apart(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """The members of buckets that hold more than one component, with their components."""
    apart = _with_several(_with_component(members, connected_components(found), "node", "component"))
    return apart if apart.head(1) else None


def _with_several(now: DataFrame) -> DataFrame:
    keys = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    return staged(now.join(broadcast_if_small(staged(keys.select("key"), "open-keys")), "key", "left_semi"), "open-buckets")


def _linkable(apart: DataFrame, rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """``apart`` with sizes, without members that can have no link in their bucket.

    Shingles that a document has alone among all these are in no other's set, so it shares at
    most ``most``, the rest, with anyone. Against the smallest set of the bucket that may be
    too little; then no pair need be tried, however large the bucket is.
    """
    nodes = broadcast_if_small(staged(apart.select("node").distinct(), "open-nodes"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))

    def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in row_slices(whole, "text", _SLICE):
                sets = shingle_sets(*word_hashes(*text_buffers(batch.column("text"))), WORDS)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(owner)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"]
                )

    shingles = texts.join(nodes, "node", "left_semi").mapInArrow(released(shingle_rows), "node long, shingle long")
    owners = shingles.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    alone = owners.where("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sizes = rows.where("node = doc_id").groupBy("node").agg(F.min("n_shingles").alias("n"))
    sizes = sizes.join(nodes, "node", "left_semi").join(alone, "node", "left")
    sizes = sizes.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    sized = apart.join(broadcast_if_small(staged(sizes, "open-sizes")), "node")
    smallest = broadcast_if_small(staged(sized.groupBy("key").agg(F.min("n").alias("smallest")), "smallest"))
    union = F.col("n") + F.greatest("smallest", "most") - F.col("most")
    possible = sized.join(smallest, "key").where(100 * F.col("most") >= percent * union).drop("smallest")
    return _with_several(possible)


def _to_most_linked(apart: DataFrame, found: DataFrame) -> DataFrame:
    """Each member with the member of its bucket that has the most links, where components differ."""
    degree = found.select(F.col("a").alias("node")).union(found.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = apart.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = ranked.groupBy("key").agg(F.max(F.struct("degree", F.col("node").alias("hub"), F.col("component").alias("hub_component"))).alias("top"))
    joined = apart.join(top, "key").where(F.col("component") != F.col("top.hub_component"))
    return _ordered(joined.select("node", F.col("top.hub").alias("other")))


def _across(apart: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components that are left in open buckets.

    Members that buckets connect are a cluster. A component of more than COMPARED members is
    cut into blocks of its own, other members are dealt into blocks by their components, and
    two blocks meet in one task by products of 0/1 matrices, unless both are of one large
    component: members that are linked already are not compared with each other. Of the links
    found in a task one for each two components leaves it.
    """
    clusters = connected_components(apart.select(F.col("node").alias("a"), F.col("key").alias("b")))
    nodes = apart.select("node", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "node")
    nodes = staged(nodes, "open-clusters")
    sizes = nodes.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("large", F.when(F.col("n") > COMPARED, F.col("component")))
    small = sizes.where("large IS NULL").groupBy("cluster").agg(F.ceil(F.sum("n") / COMPARED).cast("int").alias("parts"))
    parts = F.coalesce(F.when(F.col("large").isNotNull(), F.ceil(F.col("n") / COMPARED).cast("int")), F.col("parts"))
    parts = staged(sizes.join(small, "cluster", "left").select("cluster", "component", "large", parts.alias("parts")), "open-parts")
    dealt_by = F.when(F.col("large").isNotNull(), F.col("node")).otherwise(F.col("component"))
    part = F.pmod(F.xxhash64(dealt_by), F.col("parts")).cast("int")
    dealt = nodes.join(broadcast_if_small(parts), ["cluster", "component"])
    dealt = dealt.select("node", "component", "cluster", "large", F.struct("large", part.alias("part")).alias("own"))
    blocks = parts.groupBy("cluster", "large").agg(F.max("parts").alias("parts"))
    blocks = blocks.select("cluster", "large", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    blocks = blocks.select("cluster", F.struct("large", "part").alias("other"))
    linked_already = F.col("large").isNotNull() & F.col("large").eqNullSafe(F.col("other.large"))
    dealt = dealt.join(broadcast_if_small(staged(blocks, "open-blocks")), "cluster").where(~linked_already)
    dealt = dealt.select("node", "component", "cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(nodes.select("node")), "node", "left_semi")

    def compare(rows: pa.Table) -> pa.Table:
        node, component = (rows.column(c).to_numpy() for c in ("node", "component"))
        sets = shingle_sets(*word_hashes(*text_buffers(rows.column("text"))), WORDS)
        size = np.array([len(s) for s in sets], np.float32)
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        owner, column = owner[seen[column] > 1], column[seen[column] > 1]
        column = np.unique(column, return_inverse=True)[1]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            i, j = np.searchsorted(column, [a, a + _COLUMNS])
            part = np.zeros((len(sets), _COLUMNS), np.float32)
            part[owner[i:j], column[i:j] - a] = 1
            common += part @ part.T
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        x, y = np.nonzero(linked & (component[:, None] < component[None, :]))
        if len(x):
            pairs = np.stack([component[x], component[y]], axis=1)
            keep = np.unique(pairs, axis=0, return_index=True)[1]
            x, y = x[keep], y[keep]
        return pa.table({"a": pa.array(np.maximum(node[x], node[y])), "b": pa.array(np.minimum(node[x], node[y]))})

    return dealt.join(texts, "node").groupBy("cluster", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE
    list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id"""


@query("op8_near_dups", SQL)
def near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
