"""Parts and classes of paths and node ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is taken for code, tests, documentation and images.
CODE_SUFFIXES = ("py", "rb", "ts", "tsx", "js", "jsx", "mjs")
DOC_SUFFIXES = ("md", "rst", "txt")
IMAGE_SUFFIXES = ("gif", "jpeg", "jpg", "png", "svg")
TEST_DIRS = ("test", "tests", "spec", "__tests__")
DOC_DIRS = ("doc", "docs")
CODE = rf"\.({'|'.join(CODE_SUFFIXES)})$"
#: Documents by suffix, all below docs, and licences.
DOC = rf"\.({'|'.join(DOC_SUFFIXES)})$|^docs/|(^|/)LICENSE"
#: By directory; x.test.ts and x.spec.jsx; x_test.py and x_spec.rb; test_x.py below some directory.
TEST = rf"(^|/)({'|'.join(TEST_DIRS)})/|\.(test|spec)\.(js|jsx|ts|tsx)$|_(test|spec)\.(py|rb)$|/test_[^/]*\.py$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_of(node: Column | str) -> Column:
    """The part before the last colon."""
    return F.regexp_extract(_col(node), r"^(.*):[^:]*$", 1)


def symbol_of(node: Column | str) -> Column:
    return F.substring_index(_col(node), ":", -1)


def leaf_of(node: Column | str) -> Column:
    """The last name of the symbol."""
    return F.substring_index(symbol_of(node), ".", -1)


def kind_of(endpoint: Column | str) -> Column:
    return F.substring_index(_col(endpoint), " ", 1)


def area_of(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", 2)


def file_kind(path: Column | str, generated: str = "docs/map/") -> Column:
    """test, code, generated, doc or outside: the first that fits."""
    p = _col(path)
    return F.when(p.rlike(TEST), "test").when(p.rlike(CODE), "code").when(F.startswith(p, F.lit(generated)), "generated").when(p.rlike(DOC), "doc").otherwise("outside")


def is_documentation(path: Column | str) -> Column:
    """Whether a file is text or a picture for readers, wherever it lies: by suffix, by directory, or as a licence; case aside."""
    p = F.lower(_col(path))
    named = F.exists(F.split(p, "/"), lambda x: x.isin(*DOC_DIRS, "license"))
    return named | F.substring_index(p, ".", -1).isin(*DOC_SUFFIXES, *IMAGE_SUFFIXES) & p.contains(".")


def shortened(node: Column | str, roots: list[str]) -> Column:
    """A node or path without the longest of the roots it lies in."""
    n = _col(node)
    whole = [r.strip("/") for r in sorted(roots, key=len, reverse=True) if r.strip("/") not in ("", ".")]
    return F.coalesce(*[F.when(F.startswith(n, F.lit(f"{r}/")), F.substring(n, len(r) + 2, 1 << 30)) for r in whole], n)


def truncated(text: Column | str, limit: int = 60) -> Column:
    """At most limit characters, an ellipsis for what is cut; quotes and angle brackets replaced so that the text can be a label."""
    t = _col(text)
    cut = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t)
    return F.translate(cut, '"<>', "'‹›")


def normalised_route(path: Column | str) -> Column:
    """A path of files as a route: groups in brackets dropped, [x] and [[...x]] and [...x] as {x}, :x as {x}."""
    parts = F.filter(F.split(_col(path), "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    named = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[+(\.\.\.)?([^\]]+)\]+$", "{$2}"), r"^:(.+)$", "{$1}"))
    return F.concat(F.lit("/"), F.array_join(named, "/"))
