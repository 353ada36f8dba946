"""Registered queries: vectors, semantic search and change streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import reports, semantic
from ..operators.cells import build_cells
from ..session import run_folder, state_on_disk
from ..sources import tables
from ..streaming import debounce, timers
from ..streaming.apply import drain
from .registry import FILES, lines_of, query, words
from .vector_index import embedded_chunks

_DIM = 64

# --- plain vector work -----------------------------------------------------------------------


def _elements(df, key: str, vector: str):
    return df.select(key, F.posexplode(vector).alias("pos", "x")).select(
        key, "pos", F.round("x", 6).alias("x")
    )


@query(
    "vector_normalize",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
SELECT vec_id, CAST(unnest(range(0, len(e))) AS INTEGER) AS pos, round(unnest(e) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS x
FROM n""",
)
def vector_normalize(spark, folder):
    v = tables.table(spark, folder, "embeddings")
    return _elements(v.select("vec_id", vectors.normalize("embedding").alias("v")), "vec_id", "v")


_CENTROIDS = f"""elements AS (SELECT label, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS pos,
  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE len(embedding) = {_DIM}),
means AS (SELECT label, pos, avg(x) AS x FROM elements GROUP BY label, pos)"""


@query("mean_pool", f"WITH {_CENTROIDS} SELECT label, pos, round(x, 6) AS x FROM means")
def mean_pool(spark, folder):
    v = tables.table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")
    return _elements(semantic.mean_pool(v, ["label"], _DIM), "label", "vector")


@query(
    "vector_dim_audit",
    f"""SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS vectors, len(embedding) = {_DIM} AS matches
FROM embeddings GROUP BY len(embedding)""",
)
def vector_dim_audit(spark, folder):
    return semantic.dimension_audit(tables.chunk_vectors(spark, folder), _DIM)


_TOXIC_REPOS = """toxic AS (SELECT source AS repo, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1),
repos AS (SELECT repo FROM toxic WHERE n > (SELECT avg(n) FROM toxic))"""


@query(
    "vector_alignment",
    f"""WITH {_TOXIC_REPOS}, v AS (SELECT concat('src', CAST(vec_id % 20 AS STRING)) AS repo FROM embeddings)
SELECT repo, count(*) AS vectors FROM v WHERE repo NOT IN (SELECT repo FROM repos) GROUP BY repo""",
)
def vector_alignment(spark, folder):
    """Only repos with more toxic documents than the average are registered."""
    toxic = tables.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    counted = (
        tables.files(spark, folder).join(toxic, "doc_id", "left_semi").groupBy("repo").agg(F.count("*").alias("n"))
    )
    mean = counted.agg(F.avg("n").alias("mean")).withColumn("k", F.lit(1))
    repos = counted.withColumn("k", F.lit(1)).join(mean, "k").where("n > mean").select("repo")
    return semantic.alignment(tables.chunk_vectors(spark, folder), repos)


@query(
    "vector_move",
    f"""WITH {FILES} SELECT vec_id AS doc_id, coalesce(f.repo, concat('src', CAST(vec_id % 20 AS STRING))) AS repo,
  coalesce(f.path, 'gone') AS path
FROM embeddings LEFT JOIN (SELECT * FROM files WHERE doc_id IN (SELECT doc_id FROM labels)) f ON f.doc_id = vec_id""",
)
def vector_move(spark, folder):
    """The vectors of labelled documents follow them to where they are now."""
    rows = tables.chunk_vectors(spark, folder).select(
        F.col("chunk_id").alias("doc_id"), "repo", F.lit("gone").alias("path")
    )
    labelled = tables.table(spark, folder, "labels").select("doc_id")
    return semantic.move_metadata(rows, tables.files(spark, folder).join(labelled, "doc_id", "left_semi"))


@query(
    "vector_delete_update",
    """SELECT vec_id AS chunk_id, CASE WHEN label = 9 THEN 'archive' ELSE concat('src', CAST(vec_id % 20 AS STRING)) END AS repo
FROM embeddings WHERE label NOT IN (0, 1, 2, 3, 4)""",
)
def vector_delete_update(spark, folder):
    from ..operators.files import delete_where, update_where

    rows = tables.chunk_vectors(spark, folder)
    label = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    kept = delete_where(rows.join(label, "chunk_id"), F.col("is_code"))
    return update_where(kept, F.col("label") == 9, repo="archive").select("chunk_id", "repo")


# --- semantic search ----------------------------------------------------------------------------


def centroid_queries(spark, folder):
    """One query per label: the mean vector of its embeddings."""
    v = tables.table(spark, folder, "embeddings").withColumnRenamed("embedding", "vector")
    return semantic.mean_pool(v, ["label"], _DIM).select(F.col("label").alias("query_id"), "vector")


def _ranked_sql(pool: int, mode: str | None = None) -> str:
    base = f"""WITH {_CENTROIDS},
queries AS (SELECT label AS query_id, list(x ORDER BY pos) AS q FROM means GROUP BY label),
chunks AS (
  SELECT vec_id AS chunk_id, concat('src', CAST(vec_id % 20 AS STRING)) AS repo,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label IN (0, 1, 2, 3, 4) AS is_code,
    label IN (5, 6) AS is_doc, label IN (6, 7) AS is_config, label IN (8, 9) AS is_data FROM embeddings),
scored AS (
  SELECT query_id, chunk_id, repo, is_code, is_doc, is_config, is_data,
    round(1 - list_cosine_similarity(v, q), 9) AS distance FROM chunks, queries),
pool AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY query_id, repo ORDER BY distance, chunk_id) <= {pool})"""
    if mode is None:
        return f"{base} SELECT query_id, chunk_id, repo, round(distance, 6) AS distance FROM pool"
    weight = {
        "prefer": "CASE WHEN is_code THEN 1.2 WHEN is_doc THEN 0.8 WHEN is_config THEN 0.85 WHEN is_data THEN 0.9 ELSE 1 END",
    }.get(
        mode,
        "CASE WHEN is_doc THEN 0.85 WHEN is_config THEN 0.9 WHEN is_data THEN 0.9 WHEN is_code THEN 1.05 ELSE 1 END",
    )
    ranked = f"""{base}, reranked AS (
  SELECT *, least(1.0, 1.0 / (1.0 + greatest(distance, 1e-6)) * CAST({weight} AS DOUBLE)) AS score FROM pool)
SELECT query_id, chunk_id, repo, is_code, round(distance, 6) AS distance, round(score, 6) AS score FROM reranked"""
    if mode == "all":
        return ranked
    test = " WHERE is_code" if mode == "code" else ""
    return f"""{ranked}{test}
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reranked.score DESC, reranked.distance, repo, chunk_id) <= 20"""


def _shown(df):
    out = df.select("query_id", "chunk_id", "repo", "is_code", "distance", "score")
    return out.withColumns({"distance": F.round("distance", 6), "score": F.round("score", 6)})


@query("semantic_pool", _ranked_sql(10))
def semantic_pool(spark, folder):
    near = semantic.nearest(tables.chunk_vectors(spark, folder), centroid_queries(spark, folder), 10)
    return near.select("query_id", "chunk_id", "repo", F.round("distance", 6).alias("distance"))


@query("semantic_rerank", _ranked_sql(10, "all"))
def semantic_rerank(spark, folder):
    near = semantic.nearest(tables.chunk_vectors(spark, folder), centroid_queries(spark, folder), 10)
    return _shown(semantic.rerank(near))


@query("semantic_topk", _ranked_sql(100, "default"))
def semantic_topk(spark, folder):
    return _shown(
        semantic.semantic_search(tables.chunk_vectors(spark, folder), centroid_queries(spark, folder))
    )


@query("semantic_code_only", _ranked_sql(100, "code"))
def semantic_code_only(spark, folder):
    return _shown(
        semantic.semantic_search(
            tables.chunk_vectors(spark, folder), centroid_queries(spark, folder), code_only=True
        )
    )


@query("semantic_prefer_code", _ranked_sql(100, "prefer"))
def semantic_prefer_code(spark, folder):
    return _shown(
        semantic.semantic_search(
            tables.chunk_vectors(spark, folder), centroid_queries(spark, folder), prefer_code=True
        )
    )


def _cells(spark, folder):
    """A cell index of all chunk vectors, built anew below the shared folder."""
    return build_cells(tables.chunk_vectors(spark, folder), run_folder(spark, "cells"))


@query("semantic_index_pool", _ranked_sql(10))
def semantic_index_pool(spark, folder):
    near = _cells(spark, folder).nearest(centroid_queries(spark, folder), 10)
    return near.select("query_id", "chunk_id", "repo", F.round("distance", 6).alias("distance"))


@query("semantic_index", _ranked_sql(50, "default").replace("<= 20", "<= 10"))
def semantic_index(spark, folder):
    """The ten best of pools that are found through a cell index."""
    chunks = tables.chunk_vectors(spark, folder)
    return _shown(semantic.semantic_search(chunks, centroid_queries(spark, folder), k=10, index=_cells(spark, folder)))


# --- embedding -------------------------------------------------------------------------------------


@query(
    "embed_hash",
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents),
h AS (SELECT doc_id, md5(word) AS h FROM w)
SELECT doc_id, CAST(CAST('0x' || h[1:8] AS BIGINT) % {_DIM} AS INTEGER) AS pos,
  CAST(sum(CASE WHEN h[9] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END) AS DOUBLE) AS x
FROM h GROUP BY ALL HAVING x <> 0""",
)
def embed_hash(spark, folder):
    embed = vectors.embedder(lambda: vectors.hashing_embedder(_DIM, unit=False))
    docs = tables.table(spark, folder, "documents").select("doc_id", embed("text").alias("v"))
    return _elements(docs, "doc_id", "v").where("x <> 0").withColumn("x", F.col("x").cast("double"))


@query(
    "vector_build",
    f"""WITH {lines_of('documents')}, chunk_rows AS (
  SELECT doc_id, array_to_string(l[s + 1:s + 100], chr(10)) AS content FROM (SELECT doc_id, l, unnest(range(0, len(l), 90)) AS s FROM ln)),
counted AS (SELECT doc_id, length(content) AS n, CAST({words('content')} AS DOUBLE) AS toks FROM chunk_rows),
sized AS (SELECT doc_id, n, toks, floor(greatest(1.0, n / toks) * 1024) - floor(greatest(1.0, n / toks) * 128) AS step FROM counted)
SELECT CAST(sum(CASE WHEN toks > 2048 THEN ceil(n / step) WHEN n > 12000 THEN ceil(n / 9000.0) ELSE 1 END) AS BIGINT) AS chunks_indexed,
  count(DISTINCT doc_id) AS documents_processed FROM sized""",
)
def vector_build(spark, folder):
    """Chunk, embed and classify the whole corpus; how many chunks and documents there are."""
    rows = embedded_chunks(tables.files(spark, folder), lambda: vectors.hashing_embedder(_DIM))
    return reports.vector_build_stats(rows.where(F.size("vector") == _DIM))


# --- change streams ----------------------------------------------------------------------------------

_CHANGES = """changes AS (
  SELECT event_id, ts, concat('src', CAST(user_id % 20 AS STRING)) AS repo, concat('f', CAST(user_id AS STRING), '.py') AS path,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event_type
  FROM events)"""
_GAP_HOURS = 2
_DEBOUNCED = f"""WITH {_CHANGES},
marked AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {_GAP_HOURS * 3_600_000_000} THEN 0 ELSE 1 END AS fresh
  FROM changes WINDOW w AS (PARTITION BY repo, path ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY repo, path ORDER BY ts, event_id) AS period FROM marked)
SELECT repo, path, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, count(*) AS events,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
FROM numbered GROUP BY repo, path, period"""


def _in_micros(df):
    return df.select(
        "repo",
        "path",
        "event_type",
        "events",
        F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"),
    )


@query("debounce_batch", _DEBOUNCED)
def debounce_batch(spark, folder):
    return _in_micros(debounce.debounce_batch(tables.changes(spark, folder), _GAP_HOURS * 3600))


@query("debounce_stream", _DEBOUNCED)
def debounce_stream(spark, folder):
    """The same over a stream that reads the events to their end and then closes every
    period with one event from the far future."""
    base = run_folder(spark, "debounce")
    events = tables.table(spark, folder, "events")
    closing = events.limit(0).schema
    end = f"{base}/end"
    spark.createDataFrame([], closing).write.parquet(end)
    source = (
        spark.readStream.schema(events.schema).parquet(f"{folder}/events*.parquet")
        .unionByName(spark.readStream.schema(closing).parquet(end))
    )
    quiet = debounce.debounce_stream(
        tables.as_changes(source), f"{_GAP_HOURS} hours", watermark="40 days"
    )

    def run():
        drain(
            quiet.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    run()
    far = events.limit(1).select(
        F.lit(-1).cast("long").alias("event_id"),
        F.lit("2100-01-01").cast("timestamp_ntz").alias("ts"),
        F.lit(-1).cast("long").alias("user_id"),
        F.lit("end").alias("event_type"),
        F.lit(0.0).alias("value"),
        F.lit("{}").alias("props"),
    )
    far.write.mode("append").parquet(end)
    run()
    return _in_micros(spark.read.schema(quiet.schema).parquet(f"{base}/out")).where("path <> 'f-1.py'")


_FIRED = _DEBOUNCED.replace("<= {0}".format(_GAP_HOURS * 3_600_000_000), "< {0}".format(_GAP_HOURS * 3_600_000_000))


@query("debounce_timers", _FIRED)
def debounce_timers(spark, folder):
    """Periods that per-path timers report: events exactly the gap apart are two. The stream
    ends with an event from the far future, which lets all timers run out."""
    base = run_folder(spark, "timers")
    events = tables.changes(spark, folder)
    end = spark.createDataFrame([(-1, "end", "f-1.py", "modified")], "event_id long, repo string, path string, event_type string")
    end = end.withColumn("ts", F.lit("2100-01-01").cast("timestamp")).select(*events.columns)
    for part in (events, end):
        part.write.mode("append").parquet(f"{base}/events")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/events")
        quiet = timers.debounce_timers(source, _GAP_HOURS * 3600, watermark="40 days")
        with state_on_disk(spark):
            drain(
                quiet.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
                .trigger(availableNow=True).start()
            )
    return _in_micros(spark.read.schema(quiet.schema).parquet(f"{base}/out")).where("repo <> 'end'")


@query(
    "watch_filter",
    f"""WITH {_CHANGES}, places AS (SELECT event_id, repo, event_type, CASE
    WHEN event_id % 5 = 0 THEN concat('node_modules/', path) WHEN event_id % 5 = 1 THEN concat('src/', path, 'c')
    WHEN event_id % 5 = 2 THEN concat('docs/', path, '.tmp') ELSE concat('src/', path) END AS path FROM changes)
SELECT event_id, path FROM places
WHERE repo NOT IN ('src4', 'src5') AND path NOT LIKE 'node_modules/%'
  AND (event_type = 'deleted' OR NOT (path LIKE '%.pyc' OR path LIKE '%.tmp'))""",
)
def watch_filter(spark, folder):
    """Changes of the watched repos that pass the ignore rules."""
    n = F.col("event_id") % 5
    events = tables.changes(spark, folder).withColumn(
        "path",
        F.when(n == 0, F.concat(F.lit("node_modules/"), "path"))
        .when(n == 1, F.concat(F.lit("src/"), "path", F.lit("c")))
        .when(n == 2, F.concat(F.lit("docs/"), "path", F.lit(".tmp")))
        .otherwise(F.concat(F.lit("src/"), "path")),
    )
    options = events.select("repo").distinct().withColumn("watch", ~F.col("repo").isin("src4", "src5"))
    return debounce.kept_events(debounce.watched(events, options)).select("event_id", "path")
