"""A file tree as a DataFrame: an ignore-aware Python data source, and the other file-shaped sources and sinks.

``spark.read.format("workspace").load(root)`` gives (path, mtime_ns, size, content, is_text). The tree is walked inside the
partitions, which are directories opened from the root on, so neither listing nor reading is done on the driver; hidden files are
included, those that a rule of the tree, of the directories above it (up to a repository's root) or of a global file ignores are left out, files over ``maxBytes`` and files that aren't UTF-8 keep a null content.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylens.functions.languages import ALWAYS_EXCLUDED_DIRS, JUNK_DIRS, MAX_INDEXED_BYTES
from quarrylens.sources.storage import Folder

IGNORE_FILES = (".gitignore", ".ignore")

# ---------------------------------------------------------------- ignore rules


def ignore_rule(line: str) -> tuple[re.Pattern[str], bool, bool] | None:
    """(pattern over the path below the rule's directory, negated, directories only) of a line; null for comments."""
    line = line.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    only_dirs = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out.append("/.*")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        elif body[i] == "?":
            out.append("[^/]")
            i += 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            j = body.index("]", i + 1)
            cls = body[i + 1 : j]
            out.append("[" + ("^" + cls[1:] if cls[:1] in "!^" else cls) + "]")
            i = j + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        else:
            out.append(re.escape(body[i]))
            i += 1
    return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + "$"), negated, only_dirs


class IgnoreRules:
    """Rules of a directory and of those above it; the last rule that matches decides, a deeper file's rules last. A part is
    (directory below the root, path of the root below the rules' own directory, rules)."""

    def __init__(self, parts: tuple[tuple[str, str, list], ...] = ()) -> None:
        self.parts = parts

    @staticmethod
    def _read(path: str) -> list:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return [r for r in map(ignore_rule, f) if r]
        except OSError:
            return []

    def of_file(self, path: str) -> IgnoreRules:
        """With the rules of one more file for the whole tree."""
        rules = self._read(path)
        return IgnoreRules((*self.parts, ("", "", rules))) if rules else self

    def below(self, directory: str, prefix: str, root: str = "") -> IgnoreRules:
        rules = [r for name in IGNORE_FILES for r in self._read(os.path.join(directory, name))]
        return IgnoreRules((*self.parts, (prefix, root, rules))) if rules else self

    def ignored(self, path: str, is_dir: bool) -> bool:
        state = False
        for prefix, root, rules in self.parts:
            rel = path[len(prefix) :].lstrip("/") if prefix else f"{root}/{path}" if root else path
            for pattern, negated, only_dirs in rules:
                if (is_dir or not only_dirs) and pattern.match(rel):
                    state = not negated
        return state


# ---------------------------------------------------------------- the data source


#: Parts that a tree is cut into, where it has so many directories.
TREE_PARTS = 64


class WorkspacePartition(InputPartition):
    """A directory, with all that is below it or only its own files."""

    def __init__(self, start: str, recursive: bool) -> None:
        self.start, self.recursive = start, recursive


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path", ".")
        self.include_ignored = str(options.get("includeignored", "false")).lower() == "true"
        self.max_bytes = int(options.get("maxbytes", MAX_INDEXED_BYTES))
        self.parts = int(options.get("parts", TREE_PARTS))
        self.global_file = options.get("globalignore")
        more = [x for x in options.get("excludeddirs", "").split(",") if x]
        self.excluded = frozenset([*ALWAYS_EXCLUDED_DIRS, *([] if self.include_ignored else JUNK_DIRS), *more])

    def _rules(self, start: str) -> IgnoreRules:
        """The rules in force inside a directory: a global file's, those of the directories above the root, then down to it."""
        rules = IgnoreRules()
        if self.include_ignored:
            return rules
        if self.global_file:
            rules = rules.of_file(self.global_file)
        root = os.path.abspath(self.root)
        above = []
        while os.path.dirname(root) != root and not os.path.isdir(os.path.join(root, ".git")):
            root = os.path.dirname(root)
            above.append(root)
        for d in reversed(above if os.path.isdir(os.path.join(root, ".git")) else []):
            rules = rules.below(d, "", os.path.relpath(os.path.abspath(self.root), d))
        at = ""
        for name in ["", *(start.split("/") if start else [])]:
            at = f"{at}/{name}" if at else name
            rules = rules.below(os.path.join(self.root, at) if at else self.root, at)
        return rules

    def _entries(self, start: str, rules: IgnoreRules) -> tuple[list[str], list[str]]:
        """(directories, files) of a directory that aren't left out."""
        dirs, files = [], []
        try:
            entries = sorted(os.scandir(os.path.join(self.root, start) if start else self.root), key=lambda e: e.name)
        except OSError:
            return dirs, files
        for e in entries:
            rel = f"{start}/{e.name}" if start else e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in self.excluded and not rules.ignored(rel, True):
                    dirs.append(rel)
            elif e.is_file(follow_symlinks=False) and not rules.ignored(rel, False):
                files.append(rel)
        return dirs, files

    def partitions(self) -> list[WorkspacePartition]:
        """Directories from the root on, opened until there are ``parts`` of them: a tree below one directory is cut as well."""
        todo, out = [""], []
        while todo and len(todo) + len(out) < self.parts:
            start = todo.pop(0)
            dirs, files = self._entries(start, self._rules(start))
            todo += dirs
            if files:
                out.append(WorkspacePartition(start, False))
        return [*out, *(WorkspacePartition(x, True) for x in todo)] or [WorkspacePartition("", False)]

    def _walk(self, start: str, rules: IgnoreRules, recursive: bool) -> Iterator[str]:
        dirs, files = self._entries(start, rules)
        yield from files
        for d in dirs if recursive else []:
            yield from self._walk(d, rules if self.include_ignored else rules.below(os.path.join(self.root, d), d), True)

    def read(self, partition: WorkspacePartition) -> Iterator[tuple]:
        for rel in self._walk(partition.start, self._rules(partition.start), partition.recursive):
            full = os.path.join(self.root, rel)
            try:
                st = os.stat(full)
                text = None
                if st.st_size <= self.max_bytes:
                    with open(full, "rb") as f:
                        raw = f.read()
                    try:
                        text = raw.decode("utf-8")
                    except UnicodeDecodeError:
                        text = None
            except OSError:
                continue  # vanished in between
            yield rel, st.st_mtime_ns, st.st_size, text, text is not None


class WorkspaceDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workspace"

    def schema(self) -> str:
        return "path string, mtime_ns long, size long, content string, is_text boolean"

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader({k.lower(): v for k, v in dict(self.options).items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkspaceDataSource)


# ---------------------------------------------------------------- other sources


def ignored_directory_names(lines: DataFrame) -> DataFrame:
    """Plain directory names of an ignore file (one line a row, column ``text``): no patterns, negations or paths."""
    t = F.trim("text")
    name = F.regexp_replace(F.regexp_replace(t, "^/", ""), "/$", "")
    return lines.filter(~t.startswith("#") & ~t.startswith("!") & (F.length(name) > 0) & ~name.rlike(r"[*?\[\]/\\]")).select(name.alias("name")).distinct()


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected) of a JSON list; entries without a text query are skipped, an ``expected`` that is no list is an
    error. The list is a small file of test queries."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    if not isinstance(rows, list):
        raise ValueError("a query list must be a JSON list")
    out = []
    for r in rows:
        if not isinstance(r, dict) or not isinstance(r.get("query"), str):
            continue
        if not isinstance(r.get("expected", []), list):
            raise ValueError("expected must be a list")
        out.append((r["query"], [str(x) for x in r.get("expected", [])]))
    return spark.createDataFrame(out, "query string, expected array<string>")


def numbered_lines(raw: DataFrame) -> DataFrame:
    """Lines with ``line_no`` in the order of their partitions: each counts its own, one number a partition reaches the driver."""
    d = raw.withColumn("__id", F.monotonically_increasing_id())  # the partition above 33 bits of the row's place in it
    part = F.shiftright("__id", 33)
    before, starts = 0, []
    for r in d.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts.append((r.p, before))
        before += r.n
    first = d.sparkSession.createDataFrame(starts, "__p long, __first long")
    d = d.withColumn("__p", part).join(F.broadcast(first), "__p")  # a row a partition
    return d.withColumn("line_no", F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).drop("__id", "__p", "__first")


def event_lines(spark: SparkSession, path: str, accepted: int) -> DataFrame:
    """JSON lines of a log file with their number, parsed fields, and whether they lie after the accepted line; malformed ones
    keep nulls."""
    schema = "label string, session string, id string, status string, text string, ts long"
    e = numbered_lines(spark.read.text(path)).withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return e.select("line_no", "e.*", (F.try_parse_json("value").isNull()).alias("malformed"), (F.col("line_no") > accepted).alias("tail"))


def tag_lines(lines: DataFrame) -> DataFrame:
    """Tags from JSON lines (column ``value``): other kinds of lines and malformed ones are skipped."""
    schema = "_type string, name string, path string, language string, line int, kind string, scope string, signature string"
    return lines.select(F.from_json("value", schema).alias("t")).filter("t._type = 'tag' and t.name is not null").select(F.col("t.name").alias("symbol"), F.col("t.path").alias("file"), "t.language", "t.line", "t.kind", "t.scope", "t.signature")


# ---------------------------------------------------------------- versioned tables


class VersionedTable:
    """Parquet generations below a path, each in force once a commit file names its folder: readers see one whole generation, a
    failed write leaves the old one. A commit file is created if it isn't there, in one step, so of two writers that began from the same
    generation one fails. A generation of another format version counts as absent."""

    def __init__(self, spark: SparkSession, path: str, format_version: str = "1") -> None:
        self.spark, self.folder, self.format_version = spark, Folder(spark, path), format_version

    def _last(self) -> tuple[int, str, str]:
        done = [n for n in self.folder.names("commit") if n.isdigit()]
        return (int(done[-1]), *self.folder.read(f"commit/{done[-1]}").split()) if done else (0, "", self.format_version)

    def current(self) -> int:
        number, _, fmt = self._last()
        return number if fmt == self.format_version else 0

    def read(self) -> DataFrame | None:
        number, name, fmt = self._last()
        return self.spark.read.parquet(f"{self.folder.path}/{name}") if number and fmt == self.format_version else None

    def write(self, df: DataFrame) -> int:
        number, name = self._last()[0] + 1, f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder.path}/{name}")
        if not self.folder.claim(f"commit/{number:08d}", f"{name} {self.format_version}"):
            raise RuntimeError("another writer has committed since this one began")
        return number

    def apply(self, key: str, upserts: DataFrame, deletes: DataFrame) -> int:
        """A new generation: the old rows without touched keys, and the new ones."""
        old = self.read()
        touched = upserts.select(key).unionByName(deletes.select(key)).distinct()
        new = upserts if old is None else old.join(touched, key, "left_anti").unionByName(upserts)
        return self.write(new)
