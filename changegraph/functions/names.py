"""Names as pages show them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changegraph.functions import paths


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sentence(text: Column) -> Column:
    """The first letter in upper case, all others in lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def flow_title(flow: Column | str) -> Column:
    """A flow's id as a title: the mark of a proposal dropped, hyphens as blanks."""
    return _sentence(F.replace(F.regexp_replace(_col(flow), "^new:", ""), F.lit("-"), F.lit(" ")))


def screen_group(anchor: Column | str) -> Column:
    """The directory that a screen's file lies in."""
    return F.element_at(F.split(paths.file_of(anchor), "/"), -2)


def data_label(write: Column | str) -> Column:
    """What a step writes, `table.column` or a dotted path, as the name of the table in words."""
    return _sentence(F.replace(F.substring_index(_col(write), ".", 1), F.lit("_"), F.lit(" ")))


def opens_class(line: Column | str) -> Column:
    """Whether the first line of a definition that is no decorator opens a class."""
    return F.ltrim(_col(line)).startswith("class ")
