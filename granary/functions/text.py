"""Text predicates and rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = "\r\n|\r|\n"

# All white-space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean_trim(col: Column) -> Column:
    """Trim every kind of white space; the built-in ``trim`` strips spaces only."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def non_blank(col: Column) -> Column:
    return F.coalesce(clean_trim(col) != "", F.lit(False))


def same_text(col: Column, value: str) -> Column:
    """Equality that ignores case; null never matches."""
    return F.upper(col) == F.lit(value.upper())


def contains_pattern(col: Column, pattern: str) -> Column:
    """Does the whole text hold the pattern, whatever the case."""
    return col.rlike("(?i)" + pattern)


def lines_of(col: Column) -> Column:
    return F.split(col, NEWLINE)


def keep_lines(col: Column, prefix: str) -> Column:
    """Only the lines that start with ``prefix`` once trimmed, joined by newline."""
    kept = F.filter(F.split(col, "\r?\n"), lambda x: F.ltrim(x, F.lit(WHITE_SPACE)).startswith(prefix))
    return F.array_join(kept, "\n")


def drop_blank_line_after(col: Column, pattern: str) -> Column:
    """Remove the empty line that follows a line ending in ``pattern``, the last part of it at least."""
    return F.regexp_replace(col, rf"({pattern}\r?\n)\r?\n", "$1")


def rename_word(col: Column, capture: str, new_name: Column) -> Column:
    """Take the word the pattern captures and replace it, as a whole word, throughout.

    Texts without a match, or already carrying the new name, come back unchanged.
    """
    found = F.regexp_extract(col, "(?i)" + capture, 1)
    word = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])"), found, F.lit(r"(?![A-Za-z0-9_])"))
    literal = F.regexp_replace(new_name, r"([\\$])", r"\\$1")
    return F.when((found == "") | (found == new_name), col).otherwise(
        F.regexp_replace(col, word, literal)
    )


def column_name_clean(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit("_"))


def class_name(col: Column) -> Column:
    return F.initcap(col)


def camel_case(name: str) -> str:
    """camelCase naming: lower the leading run of capitals, keeping the last one
    of the run when a lower-case letter follows it."""
    run = len(name) - len(name.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    if run > 1 and run < len(name) and name[run].islower():
        run -= 1
    return name[:run].lower() + name[run:]
