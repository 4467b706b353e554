"""How values are compared: node ids, UI anchors and entry points, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _node(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.btrim(c, F.lit(BLANKS)), F.lit("\\"), F.lit("/")), r"^\./", "")


def _words(c: Column) -> Column:
    return F.regexp_replace(F.btrim(c, F.lit(BLANKS)), r"\s+", " ")


def _upper_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring_index(c, " ", 1)), F.substr(c, F.length(F.substring_index(c, " ", 1)) + 1))


def node(c: Column | str) -> Column:
    """`path:Name`: trimmed, `/` for `\\`, without a leading `./`; null if nothing is left."""
    return F.nullif(_node(_col(c)), F.lit(""))


def entry(c: Column | str) -> Column:
    """`KIND rest`: trimmed, single blanks, first word in upper case; null if nothing is left."""
    return F.nullif(_upper_first(_words(_col(c))), F.lit(""))


def _distinct(c: Column) -> Column:
    return F.coalesce(F.array_remove(F.array_distinct(F.array_compact(c)), ""), F.array().cast("array<string>"))


def nodes(c: Column | str) -> Column:
    """Distinct tidied node ids of an array; a null array is an empty one."""
    return _distinct(F.transform(_col(c), _node))


def entries(c: Column | str) -> Column:
    """Distinct tidied entry points of an array; a null array is an empty one.

    Each step is a pass of its own over the array: within a lambda nothing that is used twice is computed once."""
    return _distinct(F.transform(F.transform(_col(c), _words), _upper_first))
