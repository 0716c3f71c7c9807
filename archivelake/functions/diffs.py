"""Patch features found in message text, read by the unified diff format."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_TYPE = "array<struct<line:int, kind:string, value:string>>"

#: A blob id has at least seven hex digits: fixed value.
OID = "[0-9a-f]{7,64}"
NULL_DEVICE = "/dev/null"

_INDEX = re.compile(f"index ({OID})\\.\\.({OID})(?: [0-7]+)?$")
_RANGES = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@(.*)$")
_COMMAND = re.compile(r"diff (?:--git|-\S*u\S*)(?: -\S+)* (.+)$")


def unquote(name: str) -> str:
    """Undo the C-style quoting of unusual path names: octal bytes and letters."""
    if len(name) < 2 or not (name.startswith('"') and name.endswith('"')):
        return name
    raw = name[1:-1].encode("utf-8", "surrogateescape").decode("latin-1")
    return raw.encode("latin-1").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")


def common_path(a: str, b: str) -> str | None:
    """The last path components that both names share."""
    shared = []
    for left, right in zip(reversed(a.split("/")), reversed(b.split("/")), strict=False):
        if left != right:
            break
        shared.append(left)
    return "/".join(reversed(shared)) or None


def _two_names(rest: str) -> tuple[str, str] | None:
    """The names after `diff`: quoted ones, or halves around the middle space."""
    quoted = re.fullmatch(r'("(?:[^"\\]|\\.)*"|\S+) ("(?:[^"\\]|\\.)*"|\S+)', rest)
    if quoted:
        return quoted[1], quoted[2]
    middle = len(rest) // 2  # names with spaces have equal lengths
    return (rest[:middle], rest[middle + 1:]) if rest[middle:middle + 1] == " " else None


def _file_name(label: str) -> str | None:
    """Name in a `---` or `+++` line, without its first directory and time stamp."""
    name = unquote(label.split("\t")[0].rstrip())
    if name == NULL_DEVICE:
        return None
    return name.split("/", 1)[1] if "/" in name else name


class _Reader:
    """Walks the lines of a text; hunks take as many lines as their header counts."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.at = 0
        self.found: list[tuple[int, str, str]] = []
        self.named: set[str] = set()

    def add(self, kind: str, value: str) -> None:
        self.found.append((self.at, kind, value))

    def name(self, *names: str | None) -> None:
        for value in names:
            if value and value not in self.named:
                self.named.add(value)
                self.add("file", value)

    def read(self) -> list[tuple[int, str, str]]:
        while self.at < len(self.lines):
            line = self.lines[self.at]
            following = self.lines[self.at + 1] if self.at + 1 < len(self.lines) else ""
            if ranges := _RANGES.match(line):
                self.hunk(*ranges.groups())
                continue
            if line.startswith("--- ") and following.startswith("+++ "):
                self.name(_file_name(line[4:]))
                self.at += 1
                self.name(_file_name(following[4:]))
            elif command := _COMMAND.match(line):
                self.add("plain", line)
                if names := _two_names(command[1]):
                    if line.startswith("diff --git"):
                        self.name(*map(_file_name, names))
                    else:
                        self.name(common_path(*map(unquote, names)))
            elif blobs := _INDEX.match(line):
                self.add("pre", blobs[1])
                self.add("post", blobs[2])
            elif line == "GIT binary patch":
                self.binary()
                continue
            else:
                self.add("skip" if line in ("", "-- ") else "plain", line)
            self.at += 1
        return self.found

    def hunk(self, old: str | None, new: str | None, heading: str) -> None:
        if heading.strip():
            self.add("hunk", heading.strip())
        self.at += 1
        room = {"-": 1 if old is None else int(old), "+": 1 if new is None else int(new)}
        while self.at < len(self.lines) and (room["-"] or room["+"]):
            line = self.lines[self.at]
            mark = line[:1] or " "  # some mailers strip the blank of an empty line
            sides = {" ": "-+", "-": "-", "+": "+", "\\": ""}.get(mark)
            if sides is None or any(not room[s] for s in sides):
                return  # shorter than its header says
            for s in sides:
                room[s] -= 1
            self.add({" ": "context", "-": "removed", "+": "added", "\\": "skip"}[mark], line[1:])
            self.at += 1

    def binary(self) -> None:
        """`literal` or `delta` blocks, each with encoded lines up to an empty one."""
        self.add("plain", self.lines[self.at])
        self.at += 1
        while self.at < len(self.lines) and self.lines[self.at].startswith(("literal ", "delta ")):
            self.add("plain", self.lines[self.at])
            self.at += 1
            while self.at < len(self.lines):
                line = self.lines[self.at]
                self.add("skip", line)
                self.at += 1
                if not line:
                    break


def classify_lines(text: str) -> list[tuple[int, str, str]]:
    """(line number, kind, value) of every line of one unquoted text.

    Kinds: file, pre, post, context, added, removed, hunk, plain, skip. Only lines that
    a hunk header counts are context, added or removed. A name is given once per text.
    """
    return _Reader(text).read()


def _classify_batch(text: pd.Series) -> pd.Series:
    return text.map(
        lambda t: None
        if t is None
        else [{"line": n, "kind": k, "value": v} for n, k, v in classify_lines(t)]
    )


def diff_lines(text: Column) -> Column:
    """Classified lines of each text; one Arrow batch at a time (see `session.short_batches`)."""
    return F.pandas_udf(_classify_batch, LINE_TYPE)(text)


def looks_like_diff(text: Column) -> Column:
    return text.rlike(r"(?md)^(?:diff|---|\+\+\+) ")


def diff_headers(text: Column) -> Column:
    """(pre, post, path_a, path_b) of each `index` line with the file lines below it.

    Paths lose quotes, time stamp and first directory, the null device is null, and
    files with empty, `.` or `..` components are dropped.
    """
    header = f"(?md)^index ({OID})\\.\\.({OID})(?: [0-7]+)?\n--- (.+)\n\\+\\+\\+ (.+)$"
    groups = [F.regexp_extract_all(text, F.lit(header), F.lit(i)) for i in range(1, 5)]

    def path(label: Column) -> Column:
        plain = F.btrim(F.split_part(label, F.lit("\t"), F.lit(1)), F.lit('" '))
        return F.when(plain != NULL_DEVICE, F.regexp_replace(plain, "^[^/]*/", ""))

    rows = F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcd", strict=True)]), lambda r: F.struct(
        r["a"].alias("pre"), r["b"].alias("post"), path(r["c"]).alias("path_a"), path(r["d"]).alias("path_b")
    ))

    def safe(p: Column) -> Column:
        odd = F.exists(F.split(p, "/"), lambda part: part.isin("", ".", ".."))
        return ~F.coalesce(odd, F.lit(False))

    return F.filter(rows, lambda r: safe(r["path_a"]) & safe(r["path_b"]))


def diffstat(text: Column) -> Column:
    """(path, changed) of each diffstat line; renames give the new name."""
    line = r"(?md)^ (\S.*?) +\| +(\d+)(?: [+-]+)?$"
    names = F.regexp_extract_all(text, F.lit(line), F.lit(1))
    counts = F.regexp_extract_all(text, F.lit(line), F.lit(2))

    def new_name(name: Column) -> Column:
        bare = F.regexp_replace(name, r" +\((?:new|gone|mode)[^()]*\)$", "")
        inside = F.replace(F.regexp_replace(bare, r"\{[^{}]* => ([^{}]*)\}", "$1"), F.lit("//"), F.lit("/"))
        return F.element_at(F.split(inside, " => "), -1)

    return F.zip_with(names, counts, lambda n, c: F.struct(
        new_name(n).alias("path"), c.try_cast("long").alias("changed")
    ))


def patch_key(text: Column) -> Column:
    """Stable patch identity: whitespace and line numbers do not matter.

    Each file's diff lines are hashed on their own and the sorted hashes are
    hashed again, so the order of files does not matter either.
    """
    files = F.filter(
        F.split(text, r"(?md)^(?=diff --git )"), lambda s: s.startswith("diff --git ")
    )

    def one(segment: Column) -> Column:
        body = F.split_part(segment, F.lit("\n-- \n"), F.lit(1))
        kept = F.filter(
            F.split(body, "\n"), lambda ln: ln.rlike(r"^(?:diff --git |[ +-])")
        )
        return F.sha1(F.regexp_replace(F.array_join(kept, "\n"), r"[ \t\r]+", ""))

    return F.when(
        F.size(files) > 0,
        F.sha1(F.array_join(F.array_sort(F.transform(files, one)), "")),
    )
