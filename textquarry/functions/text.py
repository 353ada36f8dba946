"""Text expressions: decoding, lines, trigrams, chunks, size limits and token counts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .basics import ColumnOrName, col, let

LINE_BREAK = rf"\r\n|[{fixed.LINE_BREAK_CHARS}]"
_WORD = f"[^{fixed.SPACE_CHARS}]+"
# Three code points from every position; the class keeps a match from starting inside
# a surrogate pair.
_TRIGRAM = r"(?s)(?=([^\x{DC00}-\x{DFFF}]..))"

CHUNK_TYPE = "array<struct<start_line:int,end_line:int,content:string>>"


def decode_utf8(content: ColumnOrName) -> Column:
    """Bytes to text; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(col(content).cast("string"))


def content_hash(content: ColumnOrName) -> Column:
    """SHA-256 (hex) of the bytes, or of the UTF-8 form of a text column."""
    return F.sha2(col(content).cast("binary"), 256)


def lines(text: ColumnOrName) -> Column:
    """Text to an array of lines; a final line break does not open a new line."""
    return let(
        F.split(col(text), LINE_BREAK, -1),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def strip(text: ColumnOrName) -> Column:
    """Trim every kind of Unicode whitespace from both ends."""
    cls = fixed.SPACE_CHARS
    return F.regexp_replace(col(text), rf"\A[{cls}]++|[{cls}]++\z", "")


def trigrams(text: ColumnOrName) -> Column:
    """Distinct three-character substrings of the lower-cased text.

    Meant for short strings such as queries; whole documents go through
    ``operators.postings.gram_pairs``, which is far cheaper per character.
    """
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit(_TRIGRAM), F.lit(1)))


def token_count(text: ColumnOrName, method: str = "words") -> Column:
    """Estimated tokens: ``words`` (whitespace runs) or ``chars4`` (four characters each)."""
    t = col(text)
    if method == "chars4":
        n = F.floor((F.length(t) + 3) / 4).cast("int")
    elif method == "words":
        n = F.regexp_count(t, F.lit(_WORD))
    else:
        raise ValueError(f"unknown token count method {method!r}")
    return F.greatest(F.lit(1), n)


def token_counter(fn: Callable[[list[str]], list[int]]):
    """Wrap a tokenizer's batch counting function as a vectorised column function."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(fn(texts.tolist()), dtype="int32")

    return count


def chunk_token_counter(fn: Callable[[list[str]], list[int]]):
    """Like :func:`token_counter` for the array of a document's chunk texts."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def count(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda texts: [int(n) for n in fn(list(texts))])

    return count


def char_windows(text: ColumnOrName, window: Column | int, overlap: Column | int) -> Column:
    """Overlapping character windows: text[i : i+window] for i = 0, step, 2*step, ...

    The text is cut once into ``step``-sized cells by a possessive (never backtracking)
    match and windows are put together from neighbouring cells, so the cost is linear in
    the text; ``substring`` per window would rescan it from the start each time.
    """
    win = F.lit(window) if isinstance(window, int) else window
    ovl = F.lit(overlap) if isinstance(overlap, int) else overlap
    step = F.greatest(F.lit(1), win - ovl).cast("int")
    extra = F.ceil((win - step) / step).cast("int")
    cells = F.regexp_extract_all(
        col(text), F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}+")), F.lit(0)
    )
    return let(
        F.struct(cells.alias("cells"), extra.alias("extra"), win.cast("int").alias("win")),
        lambda b: F.transform(
            b["cells"],
            lambda c, i: F.when(b["extra"] <= 0, F.left(c, b["win"])).otherwise(
                F.left(F.array_join(F.slice(b["cells"], i + 1, b["extra"] + 1), ""), b["win"])
            ),
        ),
    )


def hard_wrap(
    text: ColumnOrName, window: int = fixed.HARD_WINDOW, overlap: int = fixed.HARD_OVERLAP
) -> Column:
    """Character windows; a non-positive window keeps the text whole."""
    if window <= 0:
        return F.array(col(text))
    return char_windows(text, window, overlap)


def chunks(
    text: ColumnOrName, max_lines: int = fixed.CHUNK_LINES, overlap: int = fixed.CHUNK_OVERLAP
) -> Column:
    """Overlapping line windows as an array of (start_line, end_line, content)."""
    if not 0 <= overlap < max_lines:
        raise ValueError("overlap must be at least 0 and below max_lines")
    step = max_lines - overlap

    def windows(ls: Column) -> Column:
        return F.when(
            F.size(ls) > 0,
            F.transform(
                F.sequence(F.lit(0), F.size(ls) - 1, F.lit(step)),
                lambda s: F.struct(
                    (s + 1).cast("int").alias("start_line"),
                    F.least(s + max_lines, F.size(ls)).cast("int").alias("end_line"),
                    F.array_join(F.slice(ls, s + 1, max_lines), "\n").alias("content"),
                ),
            ),
        ).otherwise(F.array().cast(CHUNK_TYPE))

    return let(lines(text), windows)


def _line_total(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _placed(windows: Column, start: Column, exact_lines: bool, step: Column) -> Column:
    """Windows of one chunk with line numbers.

    The plain numbering starts each window where the one before ended, which drifts
    past the overlaps; ``exact_lines`` counts the lines of the ``step`` characters each
    window really advances by.
    """
    advance = (
        (lambda w: _line_total(F.left(w, step)) - 1) if exact_lines else (lambda w: _line_total(w))
    )
    placed = F.aggregate(
        windows,
        F.struct(start.cast("int").alias("at"), F.array().cast(CHUNK_TYPE).alias("out")),
        lambda acc, w: F.struct(
            (acc["at"] + advance(w)).cast("int").alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    acc["at"].alias("start_line"),
                    (acc["at"] + _line_total(w) - 1).cast("int").alias("end_line"),
                    w.alias("content"),
                ),
            ).alias("out"),
        ),
    )
    return placed["out"]


def limit_chunks(
    chunk_array: Column,
    *,
    tokens: str = "words",
    token_counts: Column | None = None,
    max_tokens: int = fixed.MAX_TOKENS,
    target_tokens: int = fixed.TARGET_TOKENS,
    token_overlap: int = fixed.TOKEN_OVERLAP,
    hard_chars: int = fixed.HARD_CHARS,
    hard_window: int = fixed.HARD_WINDOW,
    hard_overlap: int = fixed.HARD_OVERLAP,
    exact_lines: bool = False,
) -> Column:
    """Split oversized chunks of one document; the array position is the new chunk index.

    Everything happens inside the row, so numbering needs no shuffle of the text. Token
    counts of a model's own tokenizer come in as an array beside the chunks, see
    :func:`chunk_token_counter`.
    """

    def split_one(c: Column, i: Column) -> Column:
        body = c["content"]
        toks_of = token_count(body, tokens) if token_counts is None else token_counts[i]
        n_chars = F.length(body)

        def by_tokens(toks: Column) -> Column:
            per_token = F.greatest(F.lit(1.0), n_chars / toks.cast("double"))
            win = F.greatest(F.lit(1), F.floor(per_token * target_tokens)).cast("int")
            ovl = F.greatest(F.lit(0), F.floor(per_token * token_overlap)).cast("int")
            step = F.greatest(F.lit(1), win - ovl)
            return _placed(char_windows(body, win, ovl), c["start_line"], exact_lines, step)

        hard_step = F.lit(max(1, hard_window - hard_overlap))
        by_chars = _placed(
            hard_wrap(body, hard_window, hard_overlap), c["start_line"], exact_lines, hard_step
        )
        whole = F.array(c)
        return F.when(n_chars == 0, whole).otherwise(
            let(
                toks_of,
                lambda toks: F.when(toks > max_tokens, by_tokens(toks))
                .when(n_chars > hard_chars, by_chars)
                .otherwise(whole),
            )
        )

    return F.flatten(F.transform(chunk_array, split_one))


def oversized(
    content: Column,
    *,
    tokens: str = "words",
    hard_chars: int = fixed.HARD_CHARS,
    max_tokens: int = fixed.MAX_TOKENS,
) -> Column:
    """Whether a chunk would be split by :func:`limit_chunks`."""
    return (F.length(content) > 0) & (
        (F.length(content) > hard_chars) | (token_count(content, tokens) > max_tokens)
    )


def segments(text: ColumnOrName, max_tokens: int) -> Column:
    """Cut long text for a model's token window: whole when four characters per token
    say that it fits, else plain slices of three characters per token."""
    t = col(text)
    limit = max(1, int(max_tokens))
    return F.when(F.length(t) <= limit * 4, F.array(t)).otherwise(char_windows(t, limit * 3, 0))


def truncate_bytes(content: ColumnOrName, max_bytes: int = fixed.READ_BYTES) -> Column:
    """The first ``max_bytes`` bytes as text, with a mark when something was cut."""
    raw = col(content).cast("binary")
    head = decode_utf8(F.substring(raw, 1, max_bytes))
    return F.when(
        F.octet_length(raw) > max_bytes, F.concat(head, F.lit(fixed.READ_MARK))
    ).otherwise(head)
