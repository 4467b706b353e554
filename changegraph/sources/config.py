"""Settings of an analysis from a TOML file, with a default for each; entry points are detected where none are named."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changegraph.adapters import detect
from changegraph.functions import paths
from changegraph.sources.git import VENDORED


@dataclass
class Settings:
    out: str = "docs/map"
    graph_roots: list[str] = field(default_factory=list)
    entries: list[dict] = field(default_factory=list)
    vocabulary: list[dict] = field(default_factory=list)
    plumbing: list[str] = field(default_factory=list)
    split: list[str] = field(default_factory=list)
    app_dirs: list[str] = field(default_factory=list)

    def roots(self) -> list[str]:
        """Roots of the call graph: those named, then the adapters' folders, each once."""
        named = [e.get(k) for e in self.entries for k in ("root", "commands")] + [e["main"].rpartition("/")[0] for e in self.entries if e.get("main")]
        return list(dict.fromkeys(r.strip("/") for r in [*self.graph_roots, *named] if r and r.strip("/") not in ("", ".")))

    def _below(self, path: Column, roots: list[str]) -> Column:
        """Whether a path lies below one of the roots; below nothing named, everything does."""
        some = [r.strip("/") for r in roots if r.strip("/") not in ("", ".")]
        if not some or len(some) < len(roots):
            return F.lit(True)
        return F.coalesce(*[F.when(F.startswith(path, F.lit(f"{r}/")), True) for r in some], F.lit(False))

    def in_roots(self, path: Column) -> Column:
        return self._below(path, self.roots())

    def kind(self, path: Column) -> Column:
        """test, code, generated, doc or outside; code lies below an app directory, and none of other people's is."""
        kind = paths.file_kind(path, f"{self.out.strip('/')}/")
        return F.when((kind == "code") & ~self._below(path, self.app_dirs), F.when(path.rlike(paths.DOC), "doc").otherwise("outside")).otherwise(kind)

    def graphed_files(self, files: DataFrame) -> DataFrame:
        """Of files(ref, path, ...) those that the call graph is built from: below a root, and not vendored."""
        vendored = F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*map(F.lit, VENDORED)))
        return files.filter(self.in_roots(F.col("path")) & ~vendored)

    def component(self, node: Column) -> Column:
        """The component of a node: its first two directories, or one more below a directory that is split."""
        parts = F.split(paths.file_of(node), "/")
        deep = F.coalesce(*[F.when(F.startswith(node, F.lit(f"{d.strip('/')}/")), F.lit(len(d.strip("/").split("/")) + 1)) for d in sorted(self.split, key=len, reverse=True)], F.lit(2))
        return F.array_join(F.slice(parts, F.lit(1), F.least(deep, F.greatest(F.size(parts) - 1, F.lit(1)))), "/")

    def is_plumbing(self, node: Column) -> Column:
        """Whether a node is plumbing by the settings: its symbol, its file, or a directory above it is named."""
        return F.coalesce(*[F.when((paths.symbol_of(node) == x) | (paths.leaf_of(node) == x) | (paths.file_of(node) == x) | F.startswith(node, F.lit(f"{x.rstrip('/')}/")), True) for x in self.plumbing], F.lit(False))

    def adopt(self, flow: Column) -> Column:
        """The flow that a proposed name was adopted as, else the name."""
        return F.coalesce(*[F.when(flow == old, new) for old, new in self.adopted().items()], flow)

    def flow_place(self, flow: Column) -> Column:
        """Where a flow stands: in the vocabulary's order, and behind all of it otherwise; for sorting together with the name."""
        return F.coalesce(*[F.when(flow == x, F.lit(i)) for i, x in enumerate(self.flow_order())], F.lit(len(self.flow_order())))

    def flow_order(self) -> list[str]:
        return [v["id"] for v in self.vocabulary]

    def adopted(self) -> dict[str, str]:
        """Proposed names of flows and the one each was adopted as; `proposed` is a name or a list of names."""
        out = {}
        for v in self.vocabulary:
            p = v.get("proposed", [])
            out |= dict.fromkeys([p] if isinstance(p, str) else p, v["id"])
        return out


def load(path: str | Path, tree: list[str] = ()) -> Settings:
    """tree: the repository's paths, for detection."""
    at = Path(path)
    raw = tomllib.loads(at.read_text()) if at.exists() else {}
    s = Settings(out=raw.get("out", "docs/map"), graph_roots=raw.get("graph", {}).get("roots", []), entries=raw.get("entry", []), vocabulary=raw.get("flow", []), plumbing=raw.get("plumbing", []), split=raw.get("split", []), app_dirs=raw.get("app", {}).get("dirs", []))
    if not s.entries:
        s.entries = detect(list(tree))
    return s
