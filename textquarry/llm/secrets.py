"""Secret scans over an incremental ledger of contents.

Every version of every path is named by the sha256 of its text. A ledger notes which
(content, rule, rule version) have been scanned and what was found; only pairs that are not
in it are scanned, and findings are joined back to all paths and versions that hold the
content. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.sizing import broadcast_if_small, staged
from ..session import shared_folder
from .registry import query, table

LEDGER = "blob_sha string, scanned array<struct<kind: string, version: int, spans: array<struct<start: int, stop: int>>>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least``
    characters or more. A new ``version`` of a kind is scanned for again. A kind is a name of
    letters, digits and underscores."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """A pattern of ``word`` whose ASCII letters match in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])

# Runs of one class match whole or not at all, so a least length may stand in the pattern;
# what an assignment's short value covers is passed over, so that length is asked afterwards.
BASE = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("pem", 1, "-----BEGIN (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY-----"),
    Rule("provider", 1, "gh[oprsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = (*BASE, *MORE)


def content_address(text: Column) -> Column:
    """Lower-case hex sha256 of a text's UTF-8 bytes; a null text is an empty one."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """What has been scanned so far; a folder that does not exist yet is an empty ledger."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def running_sums(values: Column) -> Column:
    """Sums of the first, the first two, ... of an array of numbers, in log2(n) passes: in each
    every element adds the one ``step`` places before it, and ``step`` doubles."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    steps = F.transform(rounds, lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(
        steps,
        values,
        lambda sums, step: F.transform(
            sums, lambda x, i: x + F.when(i >= step, F.coalesce(F.get(sums, i - step), F.lit(0))).otherwise(F.lit(0))
        ),
    )


def _scanned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Of (blob_sha, text, todo) the ledger rows: spans of all rules named in ``todo``.

    A match starts where the pieces between matches and the matches before it end, so the
    offsets are running sums of lengths; they are worked out only in texts with a match.
    """
    text, n = F.col("text"), range(len(rules))
    pattern = [F.lit(r.pattern) for r in rules]
    rows = rows.withColumns(
        {f"m{i}": F.when(F.array_contains("todo", F.lit(rules[i].name)), F.regexp_extract_all(text, pattern[i], F.lit(0))) for i in n}
    )
    hit = [F.size(f"m{i}") > 0 for i in n]
    length = lambda a: F.transform(a, F.length)
    rows = rows.withColumns(
        {
            **{f"n{i}": F.when(hit[i], length(F.col(f"m{i}"))) for i in n},
            **{f"b{i}": F.when(hit[i], length(F.split(text, rules[i].pattern, -1))) for i in n},
            **{f"v{i}": F.when(hit[i], length(F.regexp_extract_all(text, pattern[i], F.lit(rules[i].group)))) for i in n},
        }
    ).drop("text")
    both = lambda i: F.zip_with(F.slice(f"b{i}", 1, F.size(f"n{i}")), f"n{i}", lambda b, m: b + m)
    rows = rows.withColumns({f"b{i}": F.when(hit[i], both(i)) for i in n})
    rows = rows.withColumns({f"e{i}": F.when(hit[i], running_sums(F.col(f"b{i}"))) for i in n})

    def spans(i: int) -> Column:
        ends = F.zip_with(f"e{i}", f"n{i}", lambda e, m: F.struct((e - m).alias("start"), e.alias("stop")))
        kept = F.filter(F.arrays_zip(ends.alias("span"), F.col(f"v{i}").alias("value")), lambda x: x["value"] >= rules[i].least)
        none = F.expr("CAST(array() AS array<struct<start: int, stop: int>>)")
        return F.when(hit[i], F.transform(kept, lambda x: x["span"])).when(F.col(f"m{i}").isNotNull(), none)

    found = F.array(
        *(F.struct(F.lit(rules[i].kind).alias("kind"), F.lit(rules[i].version).alias("version"), spans(i).alias("spans")) for i in n)
    )
    return rows.select("blob_sha", F.filter(found, lambda x: x["spans"].isNotNull()).alias("scanned"))


def scan_unseen(versions: DataFrame, addresses: DataFrame, keys: list[str], rules: tuple[Rule, ...], ledger: str) -> int:
    """Scan the contents of ``versions`` (keys, text) for rule versions that the ledger does not
    have yet, add what was found, and return how many contents were scanned.

    ``addresses`` are the stored (keys, blob_sha) of the same rows. One row stands for each
    content. On an empty ledger all others, the copies, are taken out of the scan; later the
    contents still to be scanned are picked. Either set is broadcast while it measures small,
    so that texts stay where they are. Rows are added in one job; Spark moves its files into
    place when it commits, and a content that was scanned twice does no harm.
    """
    spark = versions.sparkSession
    key = F.struct(*(F.col(k) for k in keys)).alias("key")
    rows = versions.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = ledger_rows(spark, ledger)
    every = F.array(*(F.lit(r.name) for r in rules))
    same = F.col("key").eqNullSafe(F.col("other")) & (F.col("blob_sha") == F.col("other_sha"))
    rows = rows.withColumn("blob_sha", content_address(F.col("text")))
    hashes = addresses.select(key, "blob_sha")
    first = hashes.groupBy("blob_sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    if not known.head(1):
        several = first.where("n > 1").select("blob_sha", "first")
        copies = hashes.join(broadcast_if_small(staged(several, "blob-groups")), "blob_sha")
        copies = copies.where(~F.col("key").eqNullSafe(F.col("first")))
        copies = staged(copies.select(F.col("key").alias("other"), F.col("blob_sha").alias("other_sha")).distinct(), "blob-copies")
        unseen = rows.join(broadcast_if_small(copies), same, "left_anti").withColumn("todo", every)
        n = first.count()
    else:
        mine = known.join(broadcast_if_small(addresses.select("blob_sha").distinct()), "blob_sha", "left_semi")
        names = F.transform("scanned", lambda s: F.concat_ws("@", s["kind"], s["version"].cast("string")))
        seen = mine.groupBy("blob_sha").agg(F.array_distinct(F.flatten(F.collect_set(names))).alias("seen"))
        left = F.filter(every, lambda name: ~F.coalesce(F.array_contains("seen", name), F.lit(False)))
        todo = first.join(seen, "blob_sha", "left").select(
            F.col("first").alias("other"), F.col("blob_sha").alias("other_sha"), left.alias("todo")
        )
        todo = staged(todo.where(F.size("todo") > 0), "blob-todo")
        unseen = rows.join(broadcast_if_small(todo), same)
        n = todo.count()
    if n:
        _scanned(unseen.select("blob_sha", "text", "todo"), rules).write.mode("append").parquet(ledger)
    return n


def find_secrets(
    versions: DataFrame, ledger: str, keys: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The rows of ``versions``, their ``keys`` alone, with ``blob_sha`` and ``found``: array of (kind, version,
    start, stop) by start, then rule order; offsets in code points, ``stop`` exclusive.

    ``keys`` name a path and a version of it (a commit, a time); each row is one historical
    version, and any number may hold one content. ``ledger`` is a folder that all executors
    share and that outlives the run: contents that another run scanned for the same rule
    versions are not scanned again. A null text is empty. Null keys are keys like any other,
    and repeated rows repeat in the result. A content that very many rows hold is scanned
    once and its findings are few, so they are broadcast or, in a shuffle join, AQE splits
    its rows.
    """
    spark = versions.sparkSession
    addresses = staged(versions.select(*keys, content_address(F.col(text)).alias("blob_sha")), "blob-addresses")
    scan_unseen(versions.select(*keys, F.col(text).alias("text")), addresses, keys, rules, ledger)
    asked = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    place = lambda s: F.try_element_at(asked, F.concat_ws("@", s["kind"], s["version"].cast("string")))
    hits = ledger_rows(spark, ledger).withColumn(
        "found",
        F.flatten(
            F.transform(
                F.filter("scanned", lambda s: place(s).isNotNull()),
                lambda s: F.transform(
                    s["spans"],
                    lambda x: F.struct(
                        x["start"].alias("start"), place(s).alias("place"), s["kind"].alias("kind"), s["version"].alias("version"), x["stop"].alias("stop")
                    ),
                ),
            )
        ),
    )
    hits = hits.where(F.size("found") > 0)
    hits = hits.groupBy("blob_sha").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("found"))
    out = addresses.join(broadcast_if_small(staged(hits, "blob-findings")), "blob_sha", "left")
    spans = F.transform("found", lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "version", "start", "stop"))))
    none = F.expr("CAST(array() AS array<struct<kind: string, version: int, start: int, stop: int>>)")
    return out.select(*keys, "blob_sha", F.coalesce(spans, none).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _rule_sql(i: int, r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""m{i} AS (SELECT text, regexp_extract_all(text, '{pattern}', 0) AS m, string_split_regex(text, '{pattern}') AS b,
    regexp_extract_all(text, '{pattern}', {r.group}) AS v FROM b),
k{i} AS (SELECT text, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'stop': CAST(
    list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT),
    'm': length(m[i]), 'v': length(v[i])}})) AS x FROM m{i} WHERE len(m) > 0),
r{i} AS (SELECT text, {i} AS place, '{r.kind}' AS kind, x.stop - x.m AS start, x.stop AS stop FROM k{i} WHERE x.v >= {r.least})"""


_PARTS = ",\n".join(_rule_sql(i, r) for i, r in enumerate(RULES))
_SPAN = "kind || ':' || start || ':' || stop"
SQL = f"""WITH b AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
{_PARTS},
f AS ({" UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(RULES)))}),
g AS (SELECT text, {", ".join(f"count(*) FILTER (place = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))},
    string_agg({_SPAN}, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base,
    string_agg({_SPAN}, ',' ORDER BY start, place) AS spans FROM f GROUP BY text)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.text = coalesce(d.text, '')"""


@query("op13_secrets", SQL)
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``; each run begins a ledger of its own. Null and empty texts
    have no findings, repeated rows repeat, an empty table gives no row."""
    ledger = shared_folder(spark, f"secret-ledger-{uuid.uuid4().hex[:12]}")
    found = find_secrets(table(spark, sf_dir, "documents"), ledger, ["doc_id"])
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    base = of(*(r.kind for r in BASE))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
