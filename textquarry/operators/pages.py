"""Pages of a large ordered result: each reads the range that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizing import staged

RANGE_ROWS = 50_000  # of a range, about
PER_PAGE = 20


class PageIndex:
    """Rows below a folder that all executors share, a sub-folder for each range of their order,
    and a small table that says how many rows lie before each range."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def ranges(self) -> DataFrame:
        """(range, before, n): a row per range."""
        return self.spark.read.schema("range int, before long, n long").parquet(f"{self.folder}/ranges")

    def total(self) -> int:
        return self.ranges().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def page(self, page: int, per_page: int = PER_PAGE) -> DataFrame:
        """Rows of one page, in order; pages start at 1, and behind the last they are empty.

        The ranges' table names the one or few ranges that hold the page, and only their
        files are read; rows are counted inside a range, so nothing is sorted as a whole.
        """
        if page < 1 or per_page < 1:
            raise ValueError("pages and their sizes start at 1")
        first, last = (page - 1) * per_page, page * per_page
        ranges = self.ranges().where((F.col("before") < last) & (F.col("before") + F.col("n") > first))
        wanted = {r["range"]: r["before"] for r in ranges.collect()}  # a page spans few ranges
        columns = self.spark.read.parquet(f"{self.folder}/columns").schema.fields
        if not wanted:
            return self.spark.createDataFrame([], T.StructType(columns)).drop("place")
        schema = T.StructType([*columns, T.StructField("range", T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/rows").parquet(
            *(f"{self.folder}/rows/range={r}" for r in sorted(wanted))
        )
        before = F.create_map(*(F.lit(x) for pair in wanted.items() for x in pair))[F.col("range")]
        rows = rows.where((before + F.col("place") > first) & (before + F.col("place") <= last))
        return rows.sortWithinPartitions("range", "place").drop("range", "place")


def build_pages(rows: DataFrame, order: Sequence[str], folder: str, *, range_rows: int = RANGE_ROWS) -> PageIndex:
    """Store ``rows`` in ascending ``order`` (nulls first, other columns settle ties) in a new
    folder, in ranges of about ``range_rows`` rows. One range shuffle; every row knows its
    place in its range, and the ranges' sizes, a row each, give the places as a whole."""
    spark = rows.sparkSession
    index = PageIndex(spark, folder)
    rows = staged(rows, "page-rows")
    by = [*order, *(c for c in rows.columns if c not in order)]
    n = max(1, -(-rows.count() // range_rows))
    ranged = rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by))
    ranged = staged(ranged, "page-ranges").withColumn("place", place)
    ranged.write.mode("error").partitionBy("range").parquet(f"{index.folder}/rows")
    ranged.limit(0).drop("range").write.mode("error").parquet(f"{index.folder}/columns")
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("range", F.coalesce(before, F.lit(0)).alias("before"), "n")
    sizes.write.mode("error").parquet(f"{index.folder}/ranges")
    return index
