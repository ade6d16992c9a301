"""Source trees as DataFrames: directories are listed and files are read by tasks, and nothing is left out without a row that says why.

Spark's own file sources hide names that start with _ or a dot, which source trees are full of. The tree lies in a folder that all
executors see under the same path.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES
from ..schemas import FILES
from ..storage import stored

# Directory names that no walk enters, those of the watcher's walk, and the extensions that it knows.
SKIPPED = (
    "__pycache__", ".git", ".venv", "venv", "env", ".env", "node_modules", ".tox", "build", "dist", "_rustified", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "target", "eggs", "*.egg-info", "egg-info", ".eggs", "site-packages", "_OLD_JUNK",
)
WATCH_SKIPPED = ("__pycache__", ".git", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", "rust_output", "site-packages", ".eggs")
WATCHED = (".py", ".js", ".jsx", ".ts", ".tsx", ".html", ".htm", ".vue", ".svelte", ".rs")
LARGEST = 1 << 20
#: Rows of a listing, and bytes and files of a task that reads.
ROWS, READ_BYTES, READ_FILES = 10_000, 64 << 20, 5_000
ENTRIES = "rel string, kind string, size long, mtime double, error string"


@dataclass(frozen=True)
class Walk:
    """Which directories a walk enters and which files it lists. Suffixes are compared as given, extensions in lower case."""

    skipped: tuple[str, ...] = SKIPPED
    skipped_starts: tuple[str, ...] = ()
    dot_directories: bool = False
    suffixes: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()

    def enters(self, name: str) -> bool:
        return name not in self.skipped and not name.startswith(self.skipped_starts or "\0") and (self.dot_directories or not name.startswith("."))

    def lists(self, name: str) -> bool:
        return name.endswith(self.suffixes or "") and (not self.extensions or os.path.splitext(name)[1].lower() in self.extensions)


SCAN = Walk()
PYTHON = Walk(dot_directories=True, suffixes=(".py",))
WATCH = Walk(WATCH_SKIPPED, (".venv", "venv", "__pycache__"), True, extensions=WATCHED)


def by_extension(*extensions: str) -> Walk:
    """The walk of the analyses that look at files with these extensions."""
    return Walk(dot_directories=True, extensions=extensions)


def _listed(root: str, walk: Walk):
    def entry(top: str, e: os.DirEntry) -> tuple:
        rel = f"{top}/{e.name}" if top else e.name
        try:
            if e.is_dir():
                why = "a symbolic link to a directory" if e.is_symlink() else "" if walk.enters(e.name) else "a directory that the walk skips"
                return rel, "skipped" if why else "directory", None, None, why or None
            s = e.stat()
        except OSError as x:
            return rel, "error", None, None, f"{type(x).__name__}: {x.strerror}"
        return (rel, "file", s.st_size, s.st_mtime, None) if walk.lists(e.name) else ()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ENTRIES.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names)
        for pdf in batches:
            rows: list[tuple] = []
            for top in pdf["rel"]:
                try:
                    with os.scandir(os.path.join(root, top)) as entries:
                        for e in entries:
                            rows += filter(None, [entry(top, e)])
                            if len(rows) >= ROWS:
                                yield frame(rows)
                                rows = []
                except OSError as x:
                    rows.append((top, "error", None, None, f"{type(x).__name__}: {x.strerror}"))
            yield frame(rows)

    return run


def listing(spark: SparkSession, root: str, walk: Walk = SCAN) -> DataFrame:
    """rel, kind (file, directory, skipped, error), size, mtime, error of what the walk meets. One round a level of the tree, a row a directory dealt to tasks."""
    root = root.removeprefix("file://")
    level, out = spark.createDataFrame([("",)], "rel string"), None
    while n := level.count():
        found = stored(level.repartition(min(n, 10_000)).mapInPandas(_listed(root, walk), ENTRIES), "listing")
        out = found if out is None else out.unionByName(found)
        level = found.where("kind = 'directory'").select("rel")
    return out


def read(entries: DataFrame, root: str, largest: int = LARGEST) -> DataFrame:
    """The files of a listing, or of any table with `rel`, with `error`: why a row has no content. Larger ones and those that can't be read keep their row."""
    root = root.removeprefix("file://")
    names = [c.split()[0] for c in FILES.split(", ")]

    def one(rel: str) -> tuple:
        name = rel.rpartition("/")[2]
        ext = name.rpartition(".")[2].lower() if "." in name else ""
        path, head = os.path.join(root, rel), (rel, name, ext, LANGUAGES.get(ext))
        try:
            size = os.path.getsize(path)
            if size > largest:
                return *head, size, None, None, f"larger than {largest} bytes"
            with open(path, "rb") as f:
                data = f.read()
        except OSError as x:
            return *head, None, None, None, f"{type(x).__name__}: {x.strerror}"
        return *head, size, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 32):
                yield pd.DataFrame([one(r) for r in pdf["rel"].iloc[i : i + 32]], columns=[*names, "error"])

    return entries.select("rel").mapInPandas(run, f"{FILES}, error string")


class Tree:
    """A tree listed once: files() and errors(), which has everything that files() lacks."""

    def __init__(self, spark: SparkSession, root: str, walk: Walk = SCAN, largest: int = LARGEST):
        self.root, self.largest = root, largest
        self.entries = listing(spark, root, walk)

    def _read(self) -> DataFrame:
        here = self.entries.where("kind = 'file'")
        size = here.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.least("size", F.lit(self.largest))), F.lit(0)).alias("bytes")).first()
        return read(here.select("rel").repartition(max(1, size.bytes // READ_BYTES, size.n // READ_FILES)), self.root, self.largest)

    def files(self) -> DataFrame:
        return self._read().where("error is null").drop("error")

    def errors(self) -> DataFrame:
        """rel, error of files that are too large or can't be read, and of directories that are skipped or can't be listed."""
        return self.entries.where("error is not null").select("rel", "error").unionByName(self._read().where("error is not null").select("rel", "error"))


def files(spark: SparkSession, root: str, dot_directories: bool = False, largest: int = LARGEST) -> DataFrame:
    return Tree(spark, root, Walk(dot_directories=dot_directories), largest).files()


def from_table(df: DataFrame, rel: str, content: str) -> DataFrame:
    """files from any table of paths and texts, in whatever store."""
    from ..functions.text import language

    text = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "\r\n?", "\n")
    name = F.regexp_extract(F.col(rel), r"([^/]*)$", 1)
    return df.select(
        F.col(rel).alias("rel"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), language(F.col(rel)).alias("lang"),
        F.octet_length(content).cast("long").alias("size"), F.sha2(F.col(content), 256).alias("sha256"), text.alias("content"),
    )
