"""Source files, commands' databases and hook events as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths as P

#: A file over any of these is skipped, and listed as skipped.
MAX_BYTES, MAX_LINES, MAX_LINE_BYTES = 2 << 20, 50_000, 200_000


def source_tree(spark: SparkSession, root: str, include_tests: bool = False, ignore: list[str] | None = None, test_roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, skipped): path (below root), lang, source, is_test; and path, reason.

    The reader lists and reads in parallel. What a path alone decides is decided
    before the content is decoded, and sizes before any parser sees it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", r"^file:", "")
    rows = raw.withColumn("path", F.when(F.contains(path, F.lit(base)), F.substring(path, F.instr(path, base) + len(base), F.length(path))).otherwise(path))
    rows = rows.withColumn("lang", P.language(F.col("path"))).filter(F.col("lang").isNotNull() & ~P.is_skipped(F.col("path")) & ~P.ignored(F.col("path"), ignore or []))
    rows = rows.withColumn("is_test", P.is_test(F.col("path")))
    for test_root in test_roots or []:
        rows = rows.filter(~F.startswith("path", F.lit(test_root.rstrip("/") + "/")))
    if not include_tests:
        rows = rows.filter(~F.col("is_test"))
    rows = rows.withColumn("source", F.when(F.col("length") <= MAX_BYTES, F.try_validate_utf8("content")))
    lines = F.split("source", "\n")
    reason = (
        F.when(F.col("length") > MAX_BYTES, "bytes")
        .when(F.col("source").isNull(), "encoding")
        .when(F.size(lines) > MAX_LINES, "lines")
        .when(F.array_max(F.transform(lines, lambda x: F.octet_length(x))) > MAX_LINE_BYTES, "line_bytes")
    )
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select("path", "lang", F.regexp_replace("source", "^﻿", "").alias("source"), "is_test"), rows.filter("reason is not null").select("path", "reason")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, directory, defines, includes) of a compile_commands.json."""
    schema = "array<struct<directory:string,file:string,command:string,arguments:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("c")).select("c.*")
    args = F.coalesce("arguments", F.split("command", r"\s+"))

    def flags(letter: str) -> F.Column:
        joined = F.filter(args, lambda a: F.startswith(a, F.lit(f"-{letter}")) & (F.length(a) > 2))
        apart = F.filter(F.zip_with(args, F.slice(args, F.lit(2), F.size(args)), lambda a, b: F.when(a == f"-{letter}", b)), lambda x: x.isNotNull())
        return F.concat(F.transform(joined, lambda a: F.substring(a, 3, 1 << 20)), apart)

    return rows.select("file", "directory", flags("D").alias("defines"), flags("I").alias("includes"))


HOOK_SCHEMA = """session_id string, file_path string, edit_range array<int>,
  tool_input struct<file_path:string,old_string:string,new_string:string>,
  tool_response struct<originalFile:string,structuredPatch:array<struct<newStart:int,newLines:int>>>"""


def normalise_hooks(raw: DataFrame) -> DataFrame:
    """(session, path, first_line, last_line, old, new, original) from either form of edit event; lines span all hunks."""
    hunks = F.col("tool_response.structuredPatch")
    first = F.coalesce(F.array_min(F.transform(hunks, lambda h: h["newStart"])), F.get("edit_range", F.lit(0)))
    last = F.coalesce(F.array_max(F.transform(hunks, lambda h: h["newStart"] + F.greatest(h["newLines"], F.lit(1)) - 1)), F.get("edit_range", F.lit(1)))
    path = F.coalesce("tool_input.file_path", "file_path")
    return raw.select(F.col("session_id").alias("session"), path.alias("path"), first.alias("first_line"), last.alias("last_line"), F.col("tool_input.old_string").alias("old"), F.col("tool_input.new_string").alias("new"), F.col("tool_response.originalFile").alias("original")).filter("path is not null")


def hooks(spark: SparkSession, path: str) -> DataFrame:
    return normalise_hooks(spark.read.schema(HOOK_SCHEMA).json(path))


def package_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(versions, advisories) of a folder of cached registry answers, one JSON a package: nothing is fetched."""
    schema = "packageKey struct<system:string,name:string>, versions array<struct<versionKey:struct<version:string>,publishedAt:string,advisoryKeys:array<struct<id:string>>>>"
    rows = spark.read.schema(schema).json(path).select(F.col("packageKey.name").alias("name"), F.explode("versions").alias("v"))
    versions = rows.select("name", F.col("v.versionKey.version").alias("version"), F.col("v.publishedAt").alias("published"))
    return versions, rows.select("name", F.col("v.versionKey.version").alias("version"), F.explode("v.advisoryKeys.id").alias("advisory"))
