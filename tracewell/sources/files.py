"""Source trees as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import line_count, split_lines

MOST_BYTES = 10 * 1024 * 1024
#: Folders that are passed over (fixed values).
EXCLUDED = (".git", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".ruff_cache", "dist", "build")
#: Language of each extension (fixed values); a file called Dockerfile is one by its name.
LANGUAGES = {".py": "python", ".pyw": "python", ".java": "java", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".php": "php", ".tf": "terraform", ".rb": "ruby"}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language_of(path: Column) -> Column:
    """Language by file name or lower-cased extension; null if it isn't supported."""
    extension = F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(basename(path) == "Dockerfile", "dockerfile").otherwise(known[extension])


def in_excluded_folder(relative: Column, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    parts = F.split(relative, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(e) for e in excluded]))


#: Languages that are read as UTF-8 alone (fixed values).
UTF8_ONLY = ("go", "terraform", "dockerfile")


def decoded(content: Column, language: Column | None = None) -> Column:
    """UTF-8 where it is valid, without a byte-order mark, else Latin-1; line ends as newlines.

    In a ``language`` that is UTF-8 alone, what is not valid becomes replacement characters instead.
    """
    other = F.decode(content, "ISO-8859-1")
    if language is not None:
        other = F.when(language.isin(*UTF8_ONLY), F.make_valid_utf8(content.cast("string"))).otherwise(other)
    raw = F.coalesce(F.try_validate_utf8(content.cast("string")), other)
    return F.regexp_replace(F.regexp_replace(raw, "^﻿", ""), "\r\n?", "\n")


def relative_to(root: str, path: Column) -> Column:
    """A file's path below ``root``."""
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", ""), rf"^.*?\Q{base}\E/", "")


def read_files(spark: SparkSession, root: str, recursive: bool = True, excluded: tuple[str, ...] = EXCLUDED, most_bytes: int = MOST_BYTES, without: tuple[str, ...] = ()) -> DataFrame:
    """file_path (relative), language, size_bytes, last_modified, code, line_count, is_empty, lines of all supported files below.

    Files over ``most_bytes`` are left out before they are read, as are excluded folders, extensions in ``without`` and unknown ones. Spark's reader passes
    over files of no bytes, which hold no findings.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    files = found.where(F.col("length") <= most_bytes).withColumn("file_path", relative_to(root, F.col("path"))).withColumn("language", language_of(F.col("file_path")))
    files = files.where(F.col("language").isNotNull() & ~in_excluded_folder(F.col("file_path"), excluded))
    for extension in without:
        files = files.where(~F.lower("file_path").endswith(F.lit("." + extension.lower().lstrip("."))))
    return files.select("file_path", "language", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), decoded(F.col("content"), F.col("language")).alias("code")).select(
        "*", line_count(F.col("code")).alias("line_count"), (F.col("code") == "").alias("is_empty"), split_lines(F.col("code")).alias("lines")
    )


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files whose path is listed, however often, in ``changed`` (file_path)."""
    return files.join(changed.select("file_path").distinct(), "file_path", "left_semi")
