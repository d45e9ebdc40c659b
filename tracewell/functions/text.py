"""Columns over the lines of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators at which Python's splitlines() ends a line.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"


def split_lines(code: Column) -> Column:
    """The lines of a text, without a last empty one; an empty text has none."""
    parts = F.split(code, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(code: Column) -> Column:
    """Newlines, plus one if text follows the last."""
    return F.regexp_count(code, F.lit("\n")) + F.when((code != "") & ~F.endswith(code, F.lit("\n")), 1).otherwise(0)


def context_window(lines: Column, line_number: Column, before: int, after: int) -> Column:
    """The text of lines ``[i - before, i + after)`` of a 1-based line number, clipped to the file."""
    first = F.greatest(F.lit(1), line_number - before)
    last = F.least(F.size(lines), line_number - 1 + after)
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_comment(line: Column, language: Column) -> Column:
    """Blank lines and lines that begin as a comment of their language."""
    start = strip(line)
    slashes = start.startswith("//") | start.startswith("/*") | start.startswith("*")
    return (start == "") | (language.isin("python", "php") & start.startswith("#")) | (language.isin("java", "go", "php", "javascript", "typescript") & slashes)
