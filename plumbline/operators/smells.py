"""Findings in files: predicates over function and module rows, one scan for all of them.

functions: path, function, start_line, end_line and the metrics named below, of
which a missing one counts as zero. A predicate's sense, at least or above, is
part of its meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, Function, Module

FUNCTION_METRICS = ["cc", "cogc", "loc", "bumps", "nesting", "compound", "args", "embedded_loc", "typed", "primitive", "max_same", "asserts", "empty_catch", "short_vars", "match_arms"]


def _m(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def function_rules(t: Function = DEFAULTS.function) -> dict[str, tuple[Column, Column, Column]]:
    """smell -> (predicate, value, alert), in the order in which findings are given."""
    complex_ = (_m("cc") >= t.cc_warning) | (_m("cogc") >= t.cogc_warning)
    large = _m("loc") >= t.loc_warning
    god = complex_ & large
    ctor = F.coalesce(F.col("is_ctor"), F.lit(False))
    injected = F.greatest(_m("typed") - _m("primitive"), F.lit(0))
    floor = F.when(F.coalesce(F.col("di_framework"), F.lit(False)), F.lit(t.framework_injection_min)).otherwise(F.lit(t.injection_min))
    ratio = (_m("primitive").cast("float") / _m("typed").cast("float")).cast("float")
    no = F.lit(False)
    return {
        "god_method": (god, _m("loc"), F.lit(True)),
        "complex_method": (complex_ & ~god, _m("cc"), (_m("cc") > t.cc_alert) | (_m("cogc") > t.cogc_alert)),
        "large_method": (large & ~god, _m("loc"), _m("loc") > t.loc_alert),
        "nested_conditional_chunks": (_m("bumps") >= t.bump_count, _m("bumps"), no),
        "deep_nested_complexity": (_m("nesting") >= t.nesting_depth, _m("nesting"), no),
        "complex_conditional": (_m("compound") > t.compound_conditions, _m("compound"), no),
        "excess_arguments": (~ctor & (_m("args") > t.arg_max), _m("args"), no),
        "constructor_over_injection": (ctor & ((_m("args") > t.constructor_arg_max) | (injected >= floor)), _m("args"), no),
        "large_embedded_block": (_m("embedded_loc") > t.embedded_block_loc, _m("embedded_loc"), no),
        "primitive_obsession": ((_m("typed") >= t.primitive_min_typed) & (_m("primitive") > 0) & (_m("max_same") >= t.primitive_min_same) & (ratio >= F.lit(t.primitive_ratio).cast("float")), _m("primitive"), no),
        "large_assertion_block": (_m("asserts") > t.asserts_max, _m("asserts"), no),
        "empty_error_handler": (_m("empty_catch") > 0, _m("empty_catch"), no),
        "short_variable_names": ((_m("loc") >= t.short_var_min_loc) & (_m("short_vars") > t.short_var_max), _m("short_vars"), no),
        "stringly_typed_switch": (_m("match_arms") > t.match_arms_max, _m("match_arms"), no),
    }


def _explode(rows: DataFrame, keys: list[str], rules: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    found = [F.when(p, F.struct(F.lit(name).alias("smell"), v.cast("long").alias("value"), a.alias("alert"))) for name, (p, v, a) in rules.items()]
    return rows.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keys, "f.*")


def _fill(rows: DataFrame, names: list[str], kind: str = "int") -> DataFrame:
    for c in names:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    return rows


def function_findings(functions: DataFrame, t: Function = DEFAULTS.function, disabled: frozenset[str] = frozenset()) -> DataFrame:
    """(path, function, start_line, end_line, smell, value, alert)."""
    rows = _fill(_fill(functions, FUNCTION_METRICS), ["is_ctor", "di_framework"], "boolean")
    rules = {k: v for k, v in function_rules(t).items() if k not in disabled}
    return _explode(rows, ["path", "function", "start_line", "end_line"], rules)


MODULE_METRICS = ["loc", "functions", "sum_cc", "declarations", "global_conditionals", "global_nesting", "lcom4"]


def module_findings(modules: DataFrame, functions: DataFrame, t: Module = DEFAULTS.module, ft: Function = DEFAULTS.function) -> DataFrame:
    """(path, smell, value, alert) of files. modules: path and MODULE_METRICS."""
    god = function_rules(ft)["god_method"][0]
    own = _fill(_fill(functions, FUNCTION_METRICS), ["is_ctor", "di_framework"], "boolean").groupBy("path").agg(F.bool_or(god).alias("has_god"), F.count_if(_m("loc") >= t.large_fn_loc).alias("large_fns"))
    rows = _fill(modules, MODULE_METRICS).join(own, "path", "left")
    no = F.lit(False)
    rules = {
        "file_too_large": (_m("loc") >= t.loc_warning, _m("loc"), _m("loc") > t.loc_alert),
        "too_many_functions": (_m("functions") > t.functions, _m("functions"), no),
        "overall_complexity": (_m("sum_cc") > t.total_cc, _m("sum_cc"), no),
        "excessive_declarations": (_m("declarations") > t.declarations, _m("declarations"), no),
        "god_class": ((_m("loc") >= t.loc_warning) & (_m("functions") > t.functions) & F.coalesce("has_god", no), _m("functions"), F.lit(True)),
        "global_conditionals": (_m("global_conditionals") > t.global_conditionals, _m("global_conditionals"), no),
        "deep_global_nesting": (_m("global_nesting") >= t.global_nesting, _m("global_nesting"), no),
        "overall_function_size": (_m("large_fns") >= t.large_fn_count, _m("large_fns"), no),
        "low_cohesion": (_m("lcom4") >= t.lcom4, _m("lcom4"), no),
    }
    return _explode(rows, ["path"], rules)


def large_structs(modules: DataFrame, t: Module = DEFAULTS.module) -> DataFrame:
    """(path, struct, fields). modules: path, struct_fields (array of (name, count))."""
    return modules.select("path", F.explode("struct_fields").alias("s")).select("path", F.col("s.name").alias("struct"), F.col("s.count").alias("fields")).filter(F.col("fields") > t.struct_fields)


def duplicated_assertions(functions: DataFrame, t: Function = DEFAULTS.function) -> DataFrame:
    """(path, assert_hash, members): equal assertion blocks of test functions."""
    rows = functions.filter(F.startswith("function", F.lit("test_")) & (F.col("asserts") >= t.dup_assert_min) & (F.col("assert_hash") != 0))
    return rows.groupBy("path", "assert_hash").agg(F.count(F.lit(1)).alias("members")).filter("members >= 2")


def subsume(findings: DataFrame) -> DataFrame:
    """Findings of a function without those that its god method stands for."""
    hidden = ["complex_method", "large_method", "deep_nested_complexity"]
    gods = findings.filter("smell = 'god_method'").select("path", "function", "start_line").distinct()
    return findings.filter(~F.col("smell").isin(hidden)).unionByName(findings.filter(F.col("smell").isin(hidden)).join(gods, ["path", "function", "start_line"], "left_anti").select(*findings.columns))


def in_edit_range(findings: DataFrame, edits: DataFrame) -> DataFrame:
    """Findings whose span meets the edited lines of their path; findings without a span stay. edits: path, first_line, last_line."""
    met = findings.join(edits, "path").filter("start_line is null or (start_line <= last_line and end_line >= first_line)")
    return met.select(*findings.columns).distinct()


def code_lines(source: Column, prefixes: list[str]) -> Column:
    """Lines that are not blank and do not begin with a comment prefix."""
    starts = F.array(*[F.lit(p) for p in prefixes])
    return F.size(F.filter(F.split(source, "\n"), lambda x: (F.trim(x) != "") & ~F.exists(starts, lambda p: F.startswith(F.ltrim(x), p)))).cast("long")
