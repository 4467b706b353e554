"""Links that carry their data: raw deflate, URL-safe base64 without padding."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a fragment begins with, and how long it may be.
PREFIX, BUDGET = "#v1.", 60_000


def _deflate(t: str) -> str:
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    return base64.urlsafe_b64encode(z.compress(t.encode()) + z.flush()).decode().rstrip("=")


@F.pandas_udf(StringType())
def _deflated(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _deflate(t))


def pack(text: Column | str) -> Column:
    return F.concat(F.lit(PREFIX), _deflated(text))


def fitted(fragment: Column, *smaller: Column) -> Column:
    """The first of the fragments within the budget, else null."""
    return F.coalesce(*[F.when(F.length(f) <= BUDGET, f) for f in (fragment, *smaller)])


def _smaller(text: str) -> Iterator[str]:
    """The facts of a change without the diff text of files that aren't code, then without any; `trimmed` says what is left out."""
    try:
        facts = json.loads(text)
    except ValueError:
        return
    if not isinstance(facts, dict) or not facts.get("hunks"):
        return
    code = {f["path"] for f in facts.get("files") or () if f.get("kind") == "code"}
    trimmed: list[str] = []
    for what, kept in (("diff text of non-code files", [h for h in facts["hunks"] if h.get("file") in code]), ("all diff text", [])):
        trimmed.append(what)
        yield json.dumps({**facts, "hunks": kept, "trimmed": trimmed}, ensure_ascii=False, separators=(",", ":"))


def fitted_text(text: str) -> str | None:
    """The fragment of a change's facts; beyond the budget, that of the first of the smaller ones within it, else None."""
    fragment = PREFIX + _deflate(text)
    if len(fragment) > BUDGET:
        fragment = next((f for f in (PREFIX + _deflate(x) for x in _smaller(text)) if len(f) <= BUDGET), None)
    return fragment


@F.pandas_udf(StringType())
def fitted_facts(texts: pd.Series) -> pd.Series:
    """fitted_text of each text, null for null."""
    return texts.map(lambda t: None if t is None else fitted_text(t))


def unpack(fragment: str) -> str:
    body = fragment[len(PREFIX) :]
    return zlib.decompress(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)), -15).decode()
