"""Names that need no dependency: what comes with a language."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Modules that come with Node, and Rust's own crates. Python's are asked of Python itself.
NODE = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
RUST = "std core alloc proc_macro test crate self super".split()
RUBY = "set json yaml csv erb uri net date time tempfile fileutils digest logger ostruct optparse open3 securerandom socket stringio strscan pathname forwardable singleton timeout tsort zlib bigdecimal benchmark delegate observer pp prettyprint psych rexml shellwords monitor mutex_m openssl io etc fiddle find getoptlong ipaddr open-uri racc rinda weakref English".split()
SWIFT = "Swift Foundation UIKit SwiftUI AppKit Combine CoreData CoreGraphics CoreLocation Dispatch Darwin Glibc MapKit XCTest Testing os simd".split()


def tables() -> dict[str, list[str]]:
    return {"python": sorted(sys.stdlib_module_names), "javascript": NODE, "typescript": NODE, "rust": RUST, "ruby": RUBY, "swift": SWIFT}


def names(spark: SparkSession) -> DataFrame:
    """(lang, name) of the languages that have a list."""
    return spark.createDataFrame([(lang, x) for lang, own in tables().items() for x in own], "lang string, name string")


def is_stdlib(lang: Column, root: Column) -> Column:
    """Whether an imported root comes with its language: by the lists, for Go by a first part without a dot, for C# by System. Node's own may have the prefix node:."""
    plain = F.regexp_replace(root, "^node:", "")
    out = F.when(lang == "go", ~F.contains(F.split(root, "/")[0], F.lit("."))).when(lang == "csharp", F.lower(F.split(root, r"\.")[0]).isin("system", "mscorlib"))
    for one, own in tables().items():
        out = out.when(lang == one, plain.isin(own))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))
