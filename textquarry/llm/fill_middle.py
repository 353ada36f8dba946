"""Fill-in-the-middle training texts, cut where repeated captures of a unit end."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .registry import query, table
from .rows import fresh
from .worker import row_slices

CODE_POINT = "(?s:.)"
MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
SEED = "1"
PERCENT = 90  # of texts that are rearranged
SPM_PERCENT = 20  # of those, texts that begin with the suffix
WINDOW = 1 << 18  # code points matched at once
_SLICE = 1 << 21


class _Cutter:
    """Counts the units of a text and finds where numbered units end.

    One fullmatch of ``(unit)*`` keeps every repetition, so the ends of group 1 are the ends
    of all units. A text above ``window`` code points is matched window by window, because
    each repetition costs about a hundred bytes while it is held; all but the last unit of a
    window stand, and the next window begins where they end.
    """

    def __init__(self, unit: str, window: int = WINDOW):
        self.units = regex.compile(f"(?:({unit}))*+")
        self.window = window

    def parts(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """The ends of consecutive units, with the number of units before them."""
        at, before, window = 0, 0, self.window
        while len(text) - at > window:
            ends = self.units.match(text, at, at + window).ends(1)
            if len(ends) > 1:
                yield before, ends[:-1]
                before, at, window = before + len(ends) - 1, ends[-2], self.window
            else:
                window *= 2  # one unit is longer than the window
        match = self.units.fullmatch(text, at)
        if match is None:
            raise ValueError(f"a text is no sequence of units {self.units.pattern!r}")
        yield before, match.ends(1)

    def count(self, text: str) -> int:
        return sum(len(ends) for _, ends in self.parts(text))

    def cut(self, text: str, place) -> tuple[int, list[int]]:
        """The number n of units, and the offsets after each of ``place(n)`` units."""
        parts = self.parts(text)
        before, ends = next(parts)
        more = next(parts, None)
        if more is None:
            n = len(ends)
            return n, [ends[k - 1] if k else 0 for k in place(n)]
        n = self.count(text)
        offsets = {0: 0}
        wanted = place(n)
        for before, ends in self.parts(text):
            offsets.update((k, ends[k - before - 1]) for k in wanted if before < k <= before + len(ends))
        return n, [offsets[k] for k in wanted]


def hashes(key: Column, seed: str = SEED) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:key`` as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    unit: str = CODE_POINT,
    marks: tuple[str, str, str] = MARKS,
    seed: str = SEED,
    percent: int = PERCENT,
    spm_percent: int = SPM_PERCENT,
    window: int = WINDOW,
) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with ``fim`` (``fim_`` where there is such
    a column), a struct of

    * ``n``: the text's units, matched left to right (a null text is empty),
    * ``form``: ``plain`` if the text is empty, holds a mark, or is not chosen; ``psm`` or
      ``spm``: prefix, suffix, middle or suffix, prefix, middle,
    * ``prefix_units``, ``middle_units``, ``prefix_chars``, ``middle_chars`` (code points):
      null if plain,
    * ``output``: the text itself, or its three parts, each behind its mark.

    Cuts and forms follow from hashes of ``key`` alone, so repeated rows come out equal and
    a lost task computes the same again; a null key counts as an empty one. ``unit`` is a
    pattern of the regex library that matches no empty string (``\\X`` for graphemes,
    ``\\s*\\S+\\s*`` for words); a text above ``window`` code points is matched in windows,
    where a unit may depend on what comes after it only up to the next unit. A text that is
    no sequence of units is an error.
    """
    name, *places = fresh(docs, "fim", "fim_text", "fim_h1", "fim_h2", "fim_spm", "fim_plain")
    content, one, two, spm, plain = places
    h = hashes(F.col(key), seed)
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(F.col(content), F.lit(mark))
    rows = docs.withColumn(content, F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumns({one: h[0], two: h[1], spm: h[3] % 100 < spm_percent, plain: (F.col(content) == "") | marked | (h[2] % 100 >= percent)})
    out_type = pa.struct(
        [("n", pa.int64()), ("form", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("output", pa.string())]
    )
    kept = docs.columns

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(unit, window)
        for whole in batches:
            for batch in row_slices(whole, content, _SLICE):
                column = {c: batch.column(c) for c in places}
                found = [
                    _arranged(cutter, *(column[c][i].as_py() for c in places), marks) for i in range(batch.num_rows)
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, out_type)], [*kept, name])

    counts = [StructField(c, LongType()) for c in _COUNTS]
    fim = StructType([StructField("n", LongType()), StructField("form", StringType()), *counts, StructField("output", StringType())])
    return rows.mapInArrow(rearrange, StructType([*docs.schema.fields, StructField(name, fim)]))


_COUNTS = ("prefix_units", "middle_units", "prefix_chars", "middle_chars")


def _arranged(cutter: _Cutter, text: str, h1: int, h2: int, spm: bool, plain: bool, marks: tuple[str, str, str]) -> dict:
    if plain:
        return {"n": cutter.count(text), "form": "plain", "output": text}
    places: list[int] = []

    def place(n: int) -> list[int]:
        places[:] = sorted((h1 % (n + 1), h2 % (n + 1)))
        return places

    n, (a, b) = cutter.cut(text, place)
    prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    return {
        "n": n,
        "form": "spm" if spm else "psm",
        "prefix_units": places[0],
        "middle_units": places[1] - places[0],
        "prefix_chars": a,
        "middle_chars": b - a,
        "output": suffix + prefix + middle if spm else prefix + suffix + middle,
    }


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``fill_in_middle`` rearranged, from its output and form alone.

    No rearranged text holds a mark, and no mark ends as another begins, so each is found
    exactly where it was put.
    """
    first, second, third = (F.split(output, "|".join(re.escape(m) for m in marks), -1)[i] for i in (1, 2, 3))
    return (
        F.when(form == "psm", F.concat(first, third, second))
        .when(form == "spm", F.concat(second, third, first))
        .otherwise(output)
    )


SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h
  FROM documents),
u AS (SELECT doc_id, text, length(text) AS n, {", ".join(f"CAST('0x' || h[{1 + 8 * i}:{8 + 8 * i}] AS UBIGINT) AS h{i + 1}" for i in range(4))}
  FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
    CASE WHEN text = '' OR {" OR ".join(f"contains(text, '{m}')" for m in MARKS)} OR h3 % 100 >= {PERCENT} THEN 'plain'
      WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, '{MARKS[0]}' || substring(text, 1, a) AS p, '{MARKS[2]}' || substring(text, a + 1, b - a) AS m,
    '{MARKS[1]}' || substring(text, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM o"""


@query("op12_fill_in_middle", SQL)
def fill_in_middle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``: null and empty texts are plain with n = 0, a null doc_id
    hashes as an empty one, repeated rows repeat, an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_in_middle(docs).select("doc_id", "fim.*")
    text = restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(text.cast("binary"), 256).alias("restored_sha256"),
    )
