"""Why a file is not worth indexing: an ordered test of its name and the head of its bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from symdex.functions import names as N
from symdex.functions.paths import file_name

#: Not blank, as Python counts blanks.
NOT_BLANK = r"(?U)[^\s\x1C-\x1F]"
#: Names of generated files: minified and bundled scripts, maps, declarations, compiled files at the end; lock files anywhere.
GENERATED_NAME = r"(?i)\.(?:min|bundle|chunk)\.(?:js|css)$|\.(?:map|d\.ts|pyc|pyo)$|-lock\."


def head_text(head: Column) -> Column:
    """The head as text: UTF-8 if it is valid, else Latin-1."""
    as_text = head.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(head, "ISO-8859-1"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean_line(text: Column) -> Column:
    """Mean length of the lines that aren't blank; null without one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(NOT_BLANK)))
    return once(lines, lambda own: F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + F.length(x)) / F.nullif(F.size(own), F.lit(0)))


def skip_reason(path: Column, content: Column) -> Column:
    """The first reason that applies, or null. A null content is unreadable."""
    name = file_name(path)

    def marked(start: Column) -> Column:
        found = F.lit(False)
        for marker in N.GENERATED_MARKERS:
            found = found | F.contains(start, F.lit(marker))
        return found

    def by_text(text: Column) -> Column:
        start = F.substring(F.lower(F.substring(text, 1, N.MARKER_CHARS)), 1, N.MARKER_CHARS)  # no character gets shorter
        return F.when(F.contains(text, F.lit("\x00")), "binary_file").when(once(start, marked), "auto_generated").when(mean_line(text) > N.MOST_MEAN_LINE, "likely_minified")

    return (
        F.when(name.isin(*sorted(N.SYSTEM_FILES)), "lock_or_system_file")
        .when(F.regexp_like(name, F.lit(GENERATED_NAME)), "generated_or_minified")
        .when(content.isNull(), "unreadable")
        .otherwise(once(once(F.substring(content, 1, N.HEAD_BYTES), head_text), by_text))
    )
