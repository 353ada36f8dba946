"""File classification: code, documentation, configuration, data, extension and language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .basics import ColumnOrName, col, count_substring
from .paths import basename, language_of, parts, suffix

# Word boundaries and whitespace follow Unicode.
_UNICODE = "(?U)"


def classify(path: ColumnOrName, sample: ColumnOrName) -> Column:
    """Struct (is_code, is_doc, is_config, is_data, extension, language)."""
    ext = suffix(path)
    body = F.coalesce(col(sample), F.lit(""))
    name = F.lower(basename(path))

    def probe(pattern: str) -> Column:
        return F.rlike(body, F.lit(_UNICODE + pattern))

    doc_ext = ext.isin(*fixed.DOC_EXTENSIONS)
    config_ext = ext.isin(*fixed.CONFIG_EXTENSIONS)
    data_ext = ext.isin(*fixed.DATA_EXTENSIONS)
    code_ext = ext.isin(*fixed.CODE_EXTENSIONS) & ~(doc_ext | config_ext | data_ext)

    artifact = F.arrays_overlap(parts(path), F.array(*map(F.lit, fixed.ARTIFACT_DIRS)))
    metadata = name.isin(*fixed.METADATA_NAMES)
    bare = ext == ""

    looks_like_code = (
        F.rlike(body, F.lit(rf"\A[{fixed.SPACE_CHARS}]*#!"))
        | probe(fixed.CODE_WORDS_PROBE)
        | (
            (count_substring(body, ";") > 3)
            & (count_substring(body, "{") + count_substring(body, "}") > 1)
        )
    )
    is_code = (
        F.when(bare, looks_like_code)
        .when(metadata | artifact, F.lit(False))
        .otherwise(code_ext)
    )
    objc = probe(fixed.OBJC_PROBE)
    by_ext = language_of(path, fixed.CHUNK_LANGUAGES)
    language = (
        F.when(bare, F.when(is_code, F.lit(None).cast("string")).otherwise(F.lit("unknown")))
        .when(
            ext == ".h",
            F.when(objc, "objective-c").when(probe(fixed.CPP_PROBE), "cpp").otherwise("c"),
        )
        .otherwise(by_ext)
    )
    return F.struct(
        is_code.alias("is_code"),
        F.when(metadata, F.lit(True)).when(artifact, F.lit(False)).otherwise(doc_ext).alias("is_doc"),
        F.when(metadata | artifact, F.lit(False)).otherwise(config_ext).alias("is_config"),
        F.when(metadata, F.lit(False)).when(artifact, F.lit(True)).otherwise(data_ext).alias("is_data"),
        F.when(~bare, ext).alias("extension"),
        language.alias("language"),
    )
