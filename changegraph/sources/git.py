"""A git repository as a data source: files at revisions, and the lines that changed between two.

    spark.dataSource.register(GitFiles)
    spark.read.format("gitfiles").option("repo", path).option("refs", "main,topic").option("roots", "app,lib").load()

One partition per revision and slice of its files, so a large tree is read by many tasks; suffixes and roots are pushed into the listing.
Workers need the repository at the same path.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Stands for the files as they lie on disk, in place of a revision.
WORKTREE = "WORKTREE"
#: Directories of other people's code.
VENDORED = ("node_modules", "vendor", ".venv", "venv", "site-packages", "dist", "build", "__pycache__")


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def listed(repo: str, ref: str, roots: list[str], suffixes: tuple[str, ...]) -> list[str]:
    """Paths of a revision under the roots, each once, in order; directories of vendored code below a root are skipped."""
    out = []
    for root in roots or [""]:
        names = git(repo, "ls-tree", "-r", "-z", "--name-only", ref, *(["--", root] if root else [])).split("\0")
        for n in names:
            below = n[len(root) :].split("/")[:-1]
            if n and n.endswith(suffixes) and not set(below) & set(VENDORED):
                out.append(n)
    return list(dict.fromkeys(out))


def on_disk(repo: str, _: str, roots: list[str], suffixes: tuple[str, ...]) -> list[str]:
    """Paths of the working tree under the roots, untracked files too; directories of vendored code aren't entered."""
    out = []
    for root in roots or [""]:
        for folder, below, names in os.walk(Path(repo) / root):
            below[:] = sorted(x for x in below if x not in VENDORED and x != ".git")
            out += [(Path(folder) / n).relative_to(repo).as_posix() for n in sorted(names) if n.endswith(suffixes)]
    return list(dict.fromkeys(out))


def contents(repo: str, ref: str, paths: list[str]) -> Iterator[tuple[str, str]]:
    """(path, text) of files at a revision, all from one process that is asked for one after the other."""
    if not paths:
        return
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for path in paths:
            if "\n" in path:  # can't be asked for in a line
                yield path, git(repo, "show", f"{ref}:{path}")
                continue
            p.stdin.write(f"{ref}:{path}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) != 3:  # gone, or no file
                continue
            text = p.stdout.read(int(head[2]))
            p.stdout.read(1)
            if head[1] == b"blob":
                yield path, text.decode("utf-8", "replace")
        p.stdin.close()


def toplevel(folder: str = ".") -> str:
    """The repository's root: as the environment names it, else as git does, else the folder itself."""
    named = os.environ.get("CHANGEGRAPH_ROOT")
    if named:
        return named
    try:
        return git(folder, "rev-parse", "--show-toplevel").strip()
    except (subprocess.CalledProcessError, OSError):
        return folder


class Slice(InputPartition):
    def __init__(self, ref: str, paths: list[str]):
        self.ref, self.paths = ref, paths


class GitFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = options["repo"]
        self.refs = [r.strip() for r in options.get("refs", "HEAD").split(",")]
        self.roots = [r.strip().strip("/") for r in options.get("roots", "").split(",") if r.strip()]
        self.suffixes = tuple(s.strip() for s in options.get("suffixes", "").split(",") if s.strip()) or ("",)
        self.each = int(options.get("filesPerTask", "200"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for ref in self.refs:
            paths = (on_disk if ref == WORKTREE else listed)(self.repo, ref, self.roots, self.suffixes)
            out += [Slice(ref, paths[i : i + self.each]) for i in range(0, len(paths), self.each)]
        return out or [Slice(self.refs[0], [])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.ref == WORKTREE:
            for path in partition.paths:
                yield WORKTREE, path, (Path(self.repo) / path).read_text(encoding="utf-8", errors="replace")
        else:
            for path, text in contents(self.repo, partition.ref, partition.paths):
                yield partition.ref, path, text


class GitFiles(DataSource):
    """ref, path, text."""

    @classmethod
    def name(cls) -> str:
        return "gitfiles"

    def schema(self) -> str:
        return "ref string, path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return GitFilesReader(self.options)


HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)")


def hunks_of(diff: str) -> Iterator[tuple[str, str | None, int, int, int, int, str, list[str]]]:
    """(old path, new path, old start, old lines, new start, new lines, context, lines) of a unified diff.

    Read by counts: a hunk has as many lines as its header says, so a removed line that looks like a header is none. The new path of a
    deleted file is None."""
    old = new = None
    lines = iter(diff.split("\n"))
    for line in lines:
        if line.startswith("--- "):
            old = line[4:].removeprefix("a/")
        elif line.startswith("+++ "):
            new = None if line[4:] == "/dev/null" else line[4:].removeprefix("b/")
        elif m := HEADER.match(line):
            o, n = int(m[2] or 1), int(m[4] or 1)
            body, left, right = [], o, n
            while left > 0 or right > 0:
                x = next(lines, None)
                if x is None:
                    break
                body.append(x)
                left -= x[:1] in ("-", " ", "")
                right -= x[:1] in ("+", " ", "")
            yield old, new, int(m[1]), o, int(m[3]), n, m[5], body


class DiffReader(DataSourceReader):
    """The changed files are listed once and diffed in slices, one task each."""

    def __init__(self, options: dict):
        self.o = options
        self.each = int(options.get("filesPerTask", "200"))

    def partitions(self) -> list[InputPartition]:
        names = [n for n in git(self.o["repo"], "diff", "--no-renames", "--name-only", "-z", self.o["base"], self.o["head"]).split("\0") if n]
        return [Slice("", names[i : i + self.each]) for i in range(0, len(names), self.each)] or [Slice("", [])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.paths:
            return
        diff = git(self.o["repo"], "diff", "--no-renames", f"-U{self.o.get('context', '0')}", self.o["base"], self.o["head"], "--", *(f":(literal){p}" for p in partition.paths))
        for old, new, a, n, b, m, ctx, body in hunks_of(diff):
            yield self.o["base"], self.o["head"], new or old, new is None, a, n, b, m, ctx, body


class GitDiff(DataSource):
    """base, head, path, deleted, old_start, old_lines, new_start, new_lines, context, lines; options repo, base, head, context."""

    @classmethod
    def name(cls) -> str:
        return "gitdiff"

    def schema(self) -> str:
        return "base string, head string, path string, deleted boolean, old_start int, old_lines int, new_start int, new_lines int, context string, lines array<string>"

    def reader(self, schema) -> DataSourceReader:
        return DiffReader(self.options)


class CommitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.refs = options["repo"], [r.strip() for r in options.get("refs", "HEAD").split(",")]

    def read(self, partition) -> Iterator[tuple]:
        try:
            remote = git(self.repo, "remote", "get-url", "origin").strip()
        except subprocess.CalledProcessError:
            remote = None
        for ref in self.refs:
            sha, short, at, subject = git(self.repo, "log", "-1", "--format=%H%x00%h%x00%cI%x00%s", ref).rstrip("\n").split("\0")
            yield ref, sha, short, at, subject, remote


class GitCommits(DataSource):
    """ref, sha, short, at, subject, remote of the revisions in the option refs."""

    @classmethod
    def name(cls) -> str:
        return "gitcommits"

    def schema(self) -> str:
        return "ref string, sha string, short string, at string, subject string, remote string"

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(self.options)
