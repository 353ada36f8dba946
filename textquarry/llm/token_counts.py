"""Token counts of whole texts by a two-tier lookup on the map side."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .tokens import Cache, Encoder, slabs
from .worker import shared

FREQUENT = 1 << 15  # entries of the broadcast table
TRACKED = 1 << 16  # pieces a sketch follows
CACHED = 120_000  # other pieces in one generation of a worker's cache
LONGEST = 48  # characters of a piece in the table
LIMIT = 2048


def frequent_pieces(docs: DataFrame, k: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """The pieces between white space that are most frequent in all texts, at most k.

    Counts are frequent-item sketches of a fixed size, made by each task and merged in two
    steps, so no piece is shuffled. They choose what is broadcast; counts of tokens do not
    depend on them.
    """
    pieces = docs.select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("piece"))
    pieces = pieces.where(F.length("piece").between(1, LONGEST))
    parts = pieces.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(piece, {tracked})").alias("sketch")
    )
    merged = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {k})").alias("top")
    top = parts.groupBy(F.lit(0).alias("all")).agg(merged).first()  # no row where there are no pieces
    return sorted(x["item"] for x in top["top"]) if top else []


class _Counter:
    """Counts tokens of a text: frequent pieces first, then the worker's cache of others."""

    def __init__(self, enc: Encoder, pieces: list[str]):
        self.enc = enc
        self.others = Cache(lambda piece: len(enc.pieces.make(piece)) // 4, CACHED)
        others = self.others

        class Frequent(dict):
            def __missing__(self, piece):
                return others[piece]

        self.frequent = Frequent((p, len(enc.encode(p)) // 4) for p in pieces if enc.plain(p))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.enc.plain(text):
            return len(self.enc.whole(text)) // 4
        get = self.frequent.__getitem__
        return sum(sum(map(get, self.enc.split(x))) for x in slabs(text))


class _Pieces:
    """Counts of the sentence-piece library, which takes texts whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1)) if text else 0


def token_counter(docs: DataFrame, tokenizer: str, frequent: int = FREQUENT) -> Callable:
    """A column function that counts the tokens of whole texts; null is empty.

    ``tokenizer`` is a .json file of the tokenizers library or a .model file of
    sentencepiece. The table of frequent pieces has ``frequent`` entries at most and is
    broadcast; each worker keeps a bounded cache of the rest.
    """
    by_pieces = tokenizer.endswith(".json") and Encoder(tokenizer).kind == "words"
    pieces = frequent_pieces(docs, frequent) if by_pieces else []
    sent, key = docs.sparkSession.sparkContext.broadcast("\n".join(pieces)), uuid.uuid4().hex

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def make():
            if tokenizer.endswith(".model"):
                return _Pieces(tokenizer)
            return _Counter(Encoder(tokenizer, CACHED), sent.value.split("\n") if sent.value else [])

        counter = shared("token counter", make, key)
        for texts in batches:
            yield pd.Series([counter.count(t) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row.

    A null text is empty, a null doc_id stays null, and repeated rows are counted each.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n = token_counter(rows, tokenizer, frequent)("text")
    counted = rows.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op5_token_counts")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
