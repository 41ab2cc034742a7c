"""Version history: exported log text, and a repository by a Python data source."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MARK = "__COMMIT__"
COMMIT_FILES = "hash string, author string, ts long, file string"
LOG = ["log", "--name-only", "--use-mailmap", "--no-renames", f"--pretty=format:{MARK}%n%H%n%aE%n%at"]


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, author, ts, file) from exported log text: MARK, hash, e-mail and seconds on lines of their own, then the files. Records are split by the reader, so a large log is read in parallel."""
    records = spark.read.option("lineSep", MARK + "\n").text(path)
    lines = F.split("value", "\n")
    rows = records.filter(F.size(lines) >= 3).select(F.trim(lines[0]).alias("hash"), F.trim(lines[1]).alias("author"), F.trim(lines[2]).try_cast("long").alias("ts"), F.explode(F.array_distinct(F.filter(F.slice(lines, F.lit(4), F.size(lines)), lambda x: F.trim(x) != ""))).alias("file"))
    return rows.filter("ts is not null")


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def _git(self, *args: str) -> str:
        done = subprocess.run(["git", "-C", self.options["path"], *args], capture_output=True, text=True, errors="replace", check=False)
        return done.stdout if done.returncode == 0 else ""

    def read(self, partition: InputPartition):
        what = self.options.get("table", "commits")
        if what == "commits":
            for record in self._git(*LOG, *(["--since", self.options["since"]] if "since" in self.options else [])).split(MARK + "\n")[1:]:
                lines = record.split("\n")
                files = sorted({x for x in lines[3:] if x.strip()})
                for f in files:
                    yield lines[0], lines[1], int(lines[2]), f
        elif what == "snapshot":
            rev = self.options.get("rev", "HEAD")
            for f in self._git("ls-tree", "-r", "--name-only", rev).splitlines():
                yield f, self._git("show", f"{rev}:{f}")
        elif what == "numstat":
            for line in self._git("diff", "--numstat", "HEAD").splitlines():
                added, removed, f = line.split("\t", 2)
                yield f, (int(added) if added.isdigit() else 0) + (int(removed) if removed.isdigit() else 0)


class GitSource(DataSource):
    """spark.read.format("git").option("table", "commits" | "snapshot" | "numstat").load(repository). One reader a repository: a log is a stream."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return {"commits": COMMIT_FILES, "snapshot": "path string, source string", "numstat": "file string, lines long"}[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
