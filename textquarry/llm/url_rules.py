"""URL filters by hashed expressions of host suffixes and path prefixes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizing import broadcast_if_small
from .registry import query, table

PREFIX_BYTES = 4
DEFAULT = "allow"

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _first_bytes(digest: Column) -> Column:
    return F.conv(F.left(digest, F.lit(2 * PREFIX_BYTES)), 16, 10).cast("long")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per distinct url: url, host, path, rule and verdict.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with
    the rule's. The rule with the longest host and path together wins, of equally long ones
    the one with the longer host; of one host and path given twice, ``block``. Where none
    fits, the verdict is ``default`` and ``rule`` is null. A null url, or one without
    ``://``, has an empty host and path. Rules with a null part are ignored.

    Each url is expanded into the suffixes of its host at dots, of as many labels as the
    longest rule host has at most, times its path's prefixes of the lengths that rules have.
    Expressions meet rules on the first bytes of their SHA-256, a number, and nothing else;
    what meets is confirmed by the full digests.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.groupBy(F.lower("host").alias("_host"), F.col("path").alias("_path")).agg(F.max("verdict").alias("_verdict"))
    rules = rules.select(
        F.concat("_host", "_path").alias("_rule"),
        F.length("_host").alias("_host_length"),
        F.length("_path").alias("_path_length"),
        F.size(F.split("_host", r"\.", -1)).alias("_labels"),
        "_verdict",
        F.sha2(F.concat("_host", "_path"), 256).alias("_digest"),
    ).withColumn("_prefix", _first_bytes(F.col("_digest")))
    # No more values than the longest rule path has characters.
    shape = rules.agg(F.array_sort(F.collect_set("_path_length")).alias("lengths"), F.max("_labels").alias("labels")).first()
    lengths, most = shape["lengths"], shape["labels"] or 1

    urls = pages.select(F.col(url).alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.slice(F.reverse(F.split("host", r"\.", -1)), 1, most)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, 1, i)), ".")
    )
    expression = lambda suffix, n: F.sha2(F.concat(suffix, F.left("path", n)), 256)
    expanded = urls.select("url", "host", "path", F.explode_outer(suffixes).alias("_suffix"))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = expanded.select("url", "host", "path", "_suffix", F.explode_outer(fitting).alias("_n"))
    expanded = expanded.withColumn("_start", _first_bytes(expression(F.col("_suffix"), F.col("_n"))))
    met = expanded.join(broadcast_if_small(rules), F.col("_start") == F.col("_prefix"), "left")
    confirmed = expression(F.col("_suffix"), F.col("_n")) == F.col("_digest")
    best = met.groupBy("url", "host", "path").agg(
        F.max(
            F.when(
                confirmed,
                F.struct(
                    (F.col("_host_length") + F.col("_path_length")).alias("length"),
                    F.col("_host_length").alias("host_length"),
                    F.col("_rule").alias("rule"),
                    F.col("_verdict").alias("verdict"),
                ),
            )
        ).alias("_best")
    )
    return best.select(
        "url", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")
    )


def filter_pages(pages: DataFrame, rules: DataFrame, *, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The key, host, path, rule and verdict of every row of ``pages``, repeated rows included.

    Urls are judged once however often they occur; other columns of ``pages`` are not read.
    """
    judged = judge_urls(pages, rules, url=url, default=default).withColumnRenamed("url", "_url")
    rows = pages.select(F.col(key), F.col(url).alias("_page_url"))
    return rows.join(judged, F.col("_page_url").eqNullSafe(F.col("_url")), "left").select(
        key, "host", "path", "rule", "verdict"
    )


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


@query(
    "op10_url_rules",
    f"""WITH rules(verdict, host, path) AS (VALUES {_RULE_ROWS}),
parts AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT c.*, r.host || r.path AS rule, r.verdict FROM cut c LEFT JOIN rules r
    ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1""",
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``pages``: a null url, or one without ``://``, has an empty host and path
    and the default verdict; null and repeated page_ids stay as they are, an empty table gives
    no row."""
    return filter_pages(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
